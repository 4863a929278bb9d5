import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagecast.functions.search import MAX_LENGTH, count_below
from stagecast.operators import cdf
from tests.small import Dist

DAYS = pd.date_range("2001-03-01", periods=31)


def frame(spark, groups):
    rows = [(k, DAYS[i % 31].to_pydatetime(), float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "reachid int, datetime timestamp_ntz, value double")


def groups():
    rng = np.random.default_rng(7)
    return {
        1: rng.gamma(2.0, 30.0, 500).round(3) + 0.1,
        2: np.full(40, 5.0),                       # constant month
        3: [3.25],                                 # one value
        4: [3.25, 9.5],                            # two values
        5: np.arange(1, 65, dtype=float),          # values on the edges of the bins
        6: 3000.0 + rng.random(200),               # high datum
        7: np.r_[np.full(50, 1.0), np.full(50, 90.0)],
    }


def test_histogram_equals_numpy(spark):
    data = groups()
    found = cdf.month_histogram(frame(spark, data), "reachid", "value").toPandas()
    for key, values in data.items():
        dense = Dist(np.maximum(values, 0.1))
        rows = found[found.reachid == key].set_index("bin")["rows"]
        expected = {i: c for i, c in enumerate(dense.counts) if c}
        assert rows.to_dict() == expected, key
        assert found[found.reachid == key]["step"].iloc[0] == dense.step


def test_class_counts_of_tiny_months(spark):
    found = cdf.month_histogram(frame(spark, {3: [3.25], 4: [3.25, 9.5]}), "reachid", "value")
    steps = {r.reachid: r.step for r in found.collect()}
    assert steps[3] == pytest.approx((4 - 3) / 1)
    assert steps[4] == pytest.approx((10 - 3) / 3)


def test_shares_rise_to_exactly_one_and_stay_small(spark):
    data = groups()
    for row in cdf.packed_cdf(frame(spark, data), "reachid", "value").collect():
        assert row.cdf == sorted(row.cdf) and row.cdf[-1] == 1.0
        assert len(row.cdf) <= Dist(np.maximum(data[row.reachid], 0.1)).classes + 2 <= MAX_LENGTH
        dense = Dist(np.maximum(data[row.reachid], 0.1))
        assert np.allclose(dense.cdf[row["first"]: row["first"] + len(row.cdf)], row.cdf, atol=1e-15)
        assert row.last == pytest.approx(dense.right[-1], rel=1e-12)


def test_position_search(spark):
    rng = np.random.default_rng(3)
    rows = [(sorted(rng.integers(0, 30, n).astype(float).tolist()), float(p)) for n in (1, 2, 7, 66, 127) for p in range(-1, 31)]
    df = spark.createDataFrame(rows, "a array<double>, p double")
    for inclusive, side in ((True, "right"), (False, "left")):
        for row in count_below(df, "a", "p", "n", inclusive).collect():
            assert row.n == np.searchsorted(row.a, row.p, side)


def test_bin_numbers_at_edges(spark):
    rows = [(float(s), i) for s in (0.1, 0.3, 7.6, 12.625, 1 / 3) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "s double, i int").withColumn("v", cdf.edge(F.col("s"), F.col("i")))
    got = df.select("i", cdf.bin_number(F.col("v"), F.col("s")).alias("l"), cdf.bin_number_right(F.col("v"), F.col("s")).alias("r"))
    assert got.where("l <> i or r <> i - 1").count() == 0
