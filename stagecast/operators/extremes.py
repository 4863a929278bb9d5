"""Annual maxima, return periods and the bands drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecast.functions.scalar import gumbel
from stagecast.operators.bias import Model, map_historical
from stagecast.operators.clean import simulated
from stagecast.operators.lookup import lookup_join
from stagecast.schemas import RETURN_PERIODS
from stagecast.tables import Tables


def annual_maxima(tables: Tables, model: Model) -> DataFrame:
    """Yearly maximum of the corrected history: (hydroweb, year, max_value).

    Quantile mapping never swaps two values of one month, so only the largest simulated value of
    each (reach, year, month) is mapped: the history is reduced before it meets the stations,
    and one shuffle of twelve rows per reach-year replaces a shuffle of the series.
    """
    peaks = (
        simulated(tables.simulation)
        .groupBy("reachid", F.year("datetime").alias("year"), F.month("datetime").alias("month"))
        .agg(F.max("value").alias("value"))
    )
    mapping = model.mapping.where("complete")
    # A reach has twelve rows per year here, so no group needs cutting.
    joined = lookup_join(peaks, mapping, ["reachid", "month"])
    mapped = map_historical(joined, "value", "corrected")
    return mapped.groupBy("hydroweb", "year").agg(F.max("corrected").alias("max_value"))


def return_levels(df: DataFrame, spread: str = "spread", mean: str = "mean") -> DataFrame:
    """Add ``return_period_<rp>`` for the six return periods."""
    return df.withColumns({
        f"return_period_{rp}": gumbel(F.col(spread), F.col(mean), F.lit(rp)) for rp in RETURN_PERIODS
    })


def return_periods(maxima: DataFrame) -> DataFrame:
    """Thresholds per station from annual maxima (population standard deviation).

    ``degenerate`` marks stations whose maxima do not vary: all their thresholds are 0.
    """
    stats = maxima.groupBy("hydroweb").agg(
        F.avg("max_value").alias("mean"),
        # Equal maxima have spread 0 exactly; a running variance may leave a rounding residue.
        F.when(F.min("max_value") == F.max("max_value"), F.lit(0.0))
        .otherwise(F.stddev_pop("max_value")).alias("spread"),
    )
    return return_levels(stats).withColumn("degenerate", F.col("spread") <= 0)


def return_period_bands(thresholds: DataFrame, stats: DataFrame) -> DataFrame:
    """Bands between neighbouring thresholds for every run.

    ``stats`` are ensemble statistics. Output: (hydroweb, initialized, rp, lower, upper, visible).
    """
    peaks = stats.groupBy("hydroweb", "initialized").agg(
        F.max("flow_max").alias("y_max"),
        F.greatest(F.max("flow_max"), F.max("flow_avg"), F.max("high_res")).alias("max_visible"),
    )
    rounded = thresholds.select("hydroweb", *[
        F.round(f"return_period_{rp}", 1).alias(f"r{rp}") for rp in RETURN_PERIODS
    ])
    top = F.greatest(F.lit(2.0) * F.col("r100") - F.col("r25"), F.col("y_max"))
    uppers = list(RETURN_PERIODS[1:]) + ["max"]
    bands = F.array(*[
        F.struct(F.lit(rp).alias("rp"), F.col(f"r{rp}").alias("lower"), F.col(f"r{up}").alias("upper"))
        for rp, up in zip(RETURN_PERIODS, uppers)
    ])
    return (
        peaks.join(rounded, "hydroweb")
        .withColumn("rmax", F.when(top >= 0, F.floor(top)).otherwise(F.ceil(top)).cast("double"))
        .select("hydroweb", "initialized", (F.col("max_visible") > F.col("r2")).alias("visible"), F.explode(bands).alias("band"))
        .select("hydroweb", "initialized", "band.rp", "band.lower", "band.upper", "visible")
    )
