"""Skill of the simulation against observations.

Definitions, with s simulated and o observed values of the shared moments:

* ME = mean(s - o); RMSE = sqrt(mean((s - o)^2)); NRMSE (Mean) = RMSE / mean(o)
* MAPE = 100 * mean(|(s - o) / o|)
* NSE = 1 - sum((s - o)^2) / sum((o - mean(o))^2)
* KGE (2009) = 1 - sqrt((r-1)^2 + (sd(s)/sd(o) - 1)^2 + (mean(s)/mean(o) - 1)^2)
* KGE (2012) as 2009 with cv(s)/cv(o) for the second term, cv = sd/mean
* R (Pearson) = r; R (Spearman) = r of the average-tie ranks; r2 = r^2
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagecast.operators.bias import Model, map_historical, station_reach
from stagecast.operators.clean import observed_levels, simulated
from stagecast.operators.ranks import with_rank
from stagecast.operators.lookup import lookup_join, row_counts
from stagecast.tables import Tables
from stagecast.workspace import materialise

SKILL = ("ME", "RMSE", "NRMSE (Mean)", "NSE", "KGE (2009)", "KGE (2012)", "R (Pearson)", "R (Spearman)", "r2")
COMPARED = ("ME", "RMSE", "NRMSE (Mean)", "MAPE", "NSE", "KGE (2009)", "KGE (2012)")


def sim_obs_pairs(tables: Tables, model: Model) -> DataFrame:
    """Shared moments of both series: (hydroweb, datetime, obs, sim, corrected).

    Observations are sparse, so they meet the simulation first and only the shared moments are
    corrected.
    """
    observed = observed_levels(tables.observed)
    complete = model.mapping.where("complete").drop("complete", "sim_n", "sim_low", "sim_high")
    shared = (
        lookup_join(
            observed, station_reach(tables.station), ["hydroweb"], row_counts(observed, ["hydroweb"])
        )
        .join(simulated(tables.simulation), ["reachid", "datetime"])
        .withColumn("month", F.month("datetime"))
    )
    sizes = row_counts(shared, ["hydroweb", "month"])
    joined = lookup_join(
        shared.drop("reachid"), complete.drop("reachid"), ["hydroweb", "month"], sizes
    )
    return map_historical(joined, "value", "corrected").select(
        "hydroweb", "datetime", F.col("level").alias("obs"), F.col("value").alias("sim"), "corrected"
    )


def _aggregates(sim: Column, obs: Column, tag: str) -> list[Column]:
    error = sim - obs
    return [
        F.avg(error).alias(f"{tag}_me"),
        F.avg(error * error).alias(f"{tag}_mse"),
        F.avg(F.abs(F.try_divide(error, obs))).alias(f"{tag}_mape"),
        F.avg(sim).alias(f"{tag}_ms"),
        F.avg(obs).alias(f"{tag}_mo"),
        F.stddev_samp(sim).alias(f"{tag}_ss"),
        F.stddev_samp(obs).alias(f"{tag}_so"),
        F.var_pop(obs).alias(f"{tag}_vo"),
        F.corr(sim, obs).alias(f"{tag}_r"),
    ]


def _metric(name: str, tag: str) -> Column:
    c = {k: F.col(f"{tag}_{k}") for k in ("me", "mse", "mape", "ms", "mo", "ss", "so", "vo", "r")}
    one = F.lit(1.0)
    rmse = F.sqrt(c["mse"])
    bias_term = F.pow(F.try_divide(c["ms"], c["mo"]) - one, F.lit(2.0))
    r_term = F.pow(c["r"] - one, F.lit(2.0))
    spread = F.try_divide(c["ss"], c["so"])
    variation = F.try_divide(F.try_divide(c["ss"], c["ms"]), F.try_divide(c["so"], c["mo"]))
    return {
        "ME": c["me"],
        "RMSE": rmse,
        "NRMSE (Mean)": F.try_divide(rmse, c["mo"]),
        "MAPE": F.lit(100.0) * c["mape"],
        "NSE": one - F.try_divide(c["mse"], c["vo"]),
        "KGE (2009)": one - F.sqrt(r_term + F.pow(spread - one, F.lit(2.0)) + bias_term),
        "KGE (2012)": one - F.sqrt(r_term + F.pow(variation - one, F.lit(2.0)) + bias_term),
        "R (Pearson)": c["r"],
        "r2": c["r"] * c["r"],
    }[name]


def _long(metrics: dict[str, list[tuple[str, Column]]]) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), *[value.alias(column) for column, value in values])
        for name, values in metrics.items()
    ]))


def skill_metrics(pairs: DataFrame, range_values: int | None = None) -> DataFrame:
    """The nine skill metrics of the corrected series: (hydroweb, metric, value).

    The pairs are stored first: ranking reads them several times and joins on computed values,
    whose whole computation Catalyst would otherwise copy into the filters it derives.
    """
    pairs = materialise(pairs, "pairs")
    basic = pairs.groupBy("hydroweb").agg(*_aggregates(F.col("corrected"), F.col("obs"), "c"))
    values = pairs.select("hydroweb", "corrected", "obs")
    ranked = with_rank(with_rank(values, "hydroweb", "corrected", "rs", range_values), "hydroweb", "obs", "ro", range_values)
    spearman = ranked.groupBy("hydroweb").agg(F.corr("rs", "ro").alias("spearman"))
    metrics = {
        name: [("value", F.col("spearman") if name == "R (Spearman)" else _metric(name, "c"))] for name in SKILL
    }
    return basic.join(spearman, "hydroweb").select("hydroweb", _long(metrics).alias("m")).select("hydroweb", "m.*")


def metrics_comparison(pairs: DataFrame) -> DataFrame:
    """Metrics before and after correction: (hydroweb, metric, original, corrected)."""
    both = pairs.groupBy("hydroweb").agg(
        *_aggregates(F.col("sim"), F.col("obs"), "o"), *_aggregates(F.col("corrected"), F.col("obs"), "c")
    )
    metrics = {name: [("original", _metric(name, "o")), ("corrected", _metric(name, "c"))] for name in COMPARED}
    return both.select("hydroweb", _long(metrics).alias("m")).select("hydroweb", "m.*")
