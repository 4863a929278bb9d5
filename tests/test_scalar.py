import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagecast.functions import scalar


@pytest.fixture()
def zone_with_summer_time(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    yield
    spark.conf.set("spark.sql.session.timeZone", before)


def test_moments_do_not_depend_on_the_session_zone(spark, zone_with_summer_time):
    rows = [(dt.datetime(2024, 3, 31, 2, 30, 5, 999999), dt.datetime(2024, 3, 30, 23, 0, 0)), (dt.datetime(2024, 10, 28), dt.datetime(2024, 10, 26))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    cut = df.select(scalar.second(F.col("a")).cast("string").alias("a"))
    assert [r.a for r in cut.collect()] == ["2024-03-31 02:30:05", "2024-10-28 00:00:00"]
    assert [r[0] for r in df.select(scalar.seconds_between(F.col("a"), F.col("b"))).collect()] == [3 * 3600 + 30 * 60 + 5, 2 * 86400]


def test_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.05,), (3.0,)], "v double")
    assert [r[0] for r in df.select(scalar.clamp(scalar.present(F.col("v")))).collect()] == [None, None, 0.1, 3.0]


def test_factors(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (5.0,), (10.0,)], "v double")
    low, high = F.lit(2.0), F.lit(5.0)
    got = df.select(scalar.below_factor(F.col("v"), low), scalar.above_factor(F.col("v"), high), scalar.clip(F.col("v"), low, high)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (0.5, 1.0, 2.0), (1.0, 1.0, 2.0), (1.0, 1.0, 5.0), (1.0, 2.0, 5.0)]


def test_gumbel_limits(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1), (0.0, 5.0, 10), (-1.0, 5.0, 10), (None, 5.0, 10)], "s double, m double, rp int")
    assert [r[0] for r in df.select(scalar.gumbel(F.col("s"), F.col("m"), F.col("rp"))).collect()] == [0.0, 0.0, 0.0, None]


def test_decade_and_names(spark):
    df = spark.createDataFrame([(dt.datetime(1999, 12, 31), "a-b_c")], "t timestamp_ntz, n string")
    assert tuple(df.select(scalar.decade(F.col("t")), scalar.display_name(F.col("n"))).first()) == (1990, "A B C")
