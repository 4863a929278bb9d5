import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagecast.operators import bias, climatology, lookup, metrics, ranks, series
from tests.small import INIT, make_tables

T0 = dt.datetime(2001, 1, 1)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(9)
    return pd.DataFrame({
        "hydroweb": np.repeat(["A", "B"], 60),
        "datetime": [T0 + dt.timedelta(days=i) for i in range(60)] * 2,
        "obs": rng.integers(1, 12, 120).astype(float),
        "sim": (rng.random(120) * 20).round(3) + 1,
        "corrected": rng.integers(1, 15, 120).astype(float),
    })


def expected(s, o):
    r, mean_ratio = np.corrcoef(s, o)[0, 1], s.mean() / o.mean()
    rank = np.corrcoef(pd.Series(s).rank(), pd.Series(o).rank())[0, 1]
    rmse = np.sqrt(((s - o) ** 2).mean())
    spread = s.std(ddof=1) / o.std(ddof=1)
    return {
        "ME": (s - o).mean(), "RMSE": rmse, "NRMSE (Mean)": rmse / o.mean(), "MAPE": 100 * np.abs((s - o) / o).mean(),
        "NSE": 1 - ((s - o) ** 2).sum() / ((o - o.mean()) ** 2).sum(),
        "KGE (2009)": 1 - np.sqrt((r - 1) ** 2 + (spread - 1) ** 2 + (mean_ratio - 1) ** 2),
        "KGE (2012)": 1 - np.sqrt((r - 1) ** 2 + (spread / mean_ratio - 1) ** 2 + (mean_ratio - 1) ** 2),
        "R (Pearson)": r, "R (Spearman)": rank, "r2": r * r,
    }


@pytest.mark.parametrize("range_values, hot_rows", [(1_000_000, 2_000_000), (7, 2_000_000), (1_000_000, 3), (7, 3)])
def test_skill(spark, sample, range_values, hot_rows, monkeypatch):
    """``range_values=7`` ranks every station in pieces, ``hot_rows=3`` cuts groups of equal values."""
    monkeypatch.setattr(lookup, "HOT_ROWS", hot_rows)
    got = metrics.skill_metrics(spark.createDataFrame(sample), range_values).toPandas()
    for key, part in sample.groupby("hydroweb"):
        want = expected(part.corrected.to_numpy(), part.obs.to_numpy())
        values = got[got.hydroweb == key].set_index("metric")["value"].to_dict()
        assert set(values) == set(metrics.SKILL)
        assert values == pytest.approx({m: want[m] for m in metrics.SKILL}, abs=1e-9)


def test_comparison(spark, sample):
    got = metrics.metrics_comparison(spark.createDataFrame(sample)).toPandas()
    part = sample[sample.hydroweb == "B"]
    rows = got[got.hydroweb == "B"].set_index("metric")
    for column, values in (("original", part.sim), ("corrected", part.corrected)):
        want = expected(values.to_numpy(), part.obs.to_numpy())
        assert rows[column].to_dict() == pytest.approx({m: want[m] for m in metrics.COMPARED}, abs=1e-9)


@pytest.mark.parametrize("range_values", [1_000_000, 30])
def test_tied_ranks(spark, range_values):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": "A", "v": np.r_[np.full(500, 0.1), rng.integers(0, 400, 1500)].astype(float)})
    got = ranks.rank_table(spark.createDataFrame(frame), "k", "v", range_values).toPandas().set_index("v")["rank"]
    want = frame.assign(r=frame.v.rank()).drop_duplicates("v").set_index("v")["r"]
    assert got.sort_index().to_dict() == want.sort_index().to_dict()


def test_three_million_values_of_one_station(spark):
    """One group over many ranges, a smaller one beside it: i-th of n distinct values has rank i."""
    big = spark.range(3_000_000).select(F.lit("A").alias("k"), ((F.col("id") * 7 + 3) % 3_000_000).cast("double").alias("v"))
    small = spark.range(10).select(F.lit("B").alias("k"), (F.col("id") % 5).cast("double").alias("v"))
    got = ranks.rank_table(big.unionByName(small), "k", "v")
    assert got.where("k = 'A'").agg(F.count("*"), F.count_if(F.col("rank") == F.col("v") + 1)).first()[:] == (3_000_000, 3_000_000)
    assert sorted((r.v, r["rank"]) for r in got.where("k = 'B'").collect()) == [(float(v), 2 * v + 1.5) for v in range(5)]


def test_pairs_are_shared_moments(spark):
    days = [T0 + dt.timedelta(days=i) for i in range(28)]
    tables = make_tables(
        spark, [("A", 10), ("B", 10)],
        [(t, h, float(t.day)) for h in "AB" for t in days[::7]], [(t, 10, float(t.day)) for t in days],
    )
    got = metrics.sim_obs_pairs(tables, bias.fit(tables))
    assert got.groupBy("hydroweb").count().collect() and got.count() == 8
    assert {r.datetime for r in got.collect()} == set(days[::7])


def test_averages_keep_keys_of_either_series(spark):
    obs = spark.createDataFrame([("A", T0, 1.0), ("A", T0.replace(year=2002), 3.0)], "hydroweb string, datetime timestamp_ntz, level double")
    cor = spark.createDataFrame([("A", T0 + dt.timedelta(days=40), 5.0)], "hydroweb string, datetime timestamp_ntz, corrected double")
    assert {tuple(r) for r in climatology.daily_average(obs, cor).collect()} == {("A", "01/01", 2.0, None), ("A", "02/10", None, 5.0)}
    assert {tuple(r) for r in climatology.monthly_average(obs, cor).collect()} == {("A", 1, 2.0, None), ("A", 2, None, 5.0)}


def test_calendar_covers_every_day(spark):
    obs = spark.createDataFrame([("A", T0, 1.0), ("A", T0.replace(year=2003), 4.0)], "hydroweb string, datetime timestamp_ntz, level double")
    spans = spark.createDataFrame([("A", INIT.to_pydatetime(), dt.datetime(2001, 12, 30, 6), dt.datetime(2002, 1, 2))], "hydroweb string, initialized timestamp_ntz, start timestamp_ntz, end timestamp_ntz")
    got = climatology.calendar_values(spans, climatology.day_extremes(obs)).orderBy("datetime").collect()
    assert [(r.datetime.day, r.datetime.hour, r.level_min, r.level_max) for r in got] == [(30, 6, None, None), (31, 6, None, None), (1, 6, 1.0, 4.0)]


def test_recent_records_and_extent(spark):
    span = spark.createDataFrame([(h, INIT.to_pydatetime(), INIT.to_pydatetime(), (INIT + pd.Timedelta(days=9)).to_pydatetime()) for h in "AB"], "hydroweb string, initialized timestamp_ntz, start timestamp_ntz, end timestamp_ntz")
    records = spark.createDataFrame([("A", (INIT - pd.Timedelta(days=d)).to_pydatetime(), float(d)) for d in (-1, 0, 3, 8, 9)], "hydroweb string, datetime timestamp_ntz, corrected double")
    recent = series.recent_records(records, span)
    assert sorted(r.corrected for r in recent.collect()) == [0.0, 3.0, 8.0]
    starts = {r.hydroweb: r.start for r in series.chart_span(span, recent).collect()}
    assert starts == {"A": (INIT - pd.Timedelta(days=8)).to_pydatetime(), "B": INIT.to_pydatetime()}


@pytest.mark.parametrize("range_values", [1000, 100, 7])
def test_ranks_of_groups_that_fit_a_task_share_one_shuffle(spark, range_values):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": ["A"] * 200 + ["B"] * 50 + [None], "x": rng.integers(0, 20, 251).astype(float), "y": rng.integers(0, 9, 251).astype(float)})
    frame.loc[[3, 210], "x"] = np.nan
    rows = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).localCheckpoint()
    got = ranks.with_rank(ranks.with_rank(rows, "k", "x", "rx", range_values), "k", "y", "ry", range_values)
    left = frame.dropna()
    want = left.assign(rx=left.groupby("k").x.rank(), ry=left.groupby("k").y.rank())
    assert sorted(map(tuple, got.select("k", "x", "y", "rx", "ry").collect())) == sorted(want.itertuples(index=False, name=None))
    if range_values == 1000:
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
