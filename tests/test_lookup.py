import pytest
from pyspark.sql import functions as F

from stagecast.operators.lookup import fits_broadcast, hot_groups, lookup_join, measured_bytes, split_join
from stagecast.workspace import materialise, shared_root


@pytest.fixture(scope="module")
def data(spark):
    # Key 0 holds a third of the rows, and these are all the same row.
    hot = spark.range(3000).select(F.lit(0).alias("k"), F.lit(1).alias("v"))
    rest = spark.range(6000).select((F.col("id") % 300 + 1).cast("int").alias("k"), F.col("id").cast("int").alias("v"))
    rows = hot.unionByName(rest)
    lookup = spark.range(0, 250).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    return rows, lookup, rows.groupBy("k").agg(F.count("*").alias("n"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_no_row_is_lost_or_repeated(data, how):
    rows, lookup, sizes = data
    got = split_join(rows, lookup, ["k"], sizes, how, hot_rows=100)
    want = rows.join(lookup, ["k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_group_reaches_many_tasks(data):
    """Pieces of the hot key: identical rows spread by the partitions they came from."""
    rows, lookup, sizes = data
    joined = split_join(rows, lookup.withColumn("w", F.lit(1)), ["k"], sizes, "inner", hot_rows=100)
    plan = joined._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "_piece" in plan


def test_other_joins_are_refused(data):
    rows, lookup, _ = data
    with pytest.raises(ValueError):
        lookup_join(rows, lookup, ["k"], how="full_outer")


def test_size_check_measures_the_rows(spark):
    numbers = materialise(spark.range(1000), "size-check")
    assert measured_bytes(numbers) == 48_000 and fits_broadcast(numbers, 48_000) and not fits_broadcast(numbers, 47_999)
    wide = numbers.select("id", F.repeat(F.lit("x"), F.when(F.col("id") == 7, 100_000).otherwise(1)).alias("name"))
    assert measured_bytes(wide) - measured_bytes(numbers) == 1000 * 16 + 999 + 100_000       # one wide row counts as it is
    nested = numbers.select(F.array(F.lit(1.5), F.lit(2.5)).alias("a"), F.struct(F.lit("abc").alias("s")).alias("t"))
    assert measured_bytes(nested) == 1000 * (32 + 40 + 16 + 19) and measured_bytes(nested.where("false")) == 0


@pytest.mark.parametrize("threshold, joined", [("10MB", "BroadcastHashJoin"), ("-1", "SortMergeJoin")])
def test_every_hot_group_is_cut(spark, threshold, joined):
    """5,000 hot groups, whether their list is short enough to be broadcast or not."""
    rows = spark.range(60_000).select((F.col("id") % 6000).alias("k"), F.col("id").alias("v")).where("k < 5000 OR v < 6000")
    table = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_groups(sizes, ["k"], 5)
    assert hot.count() == 5000 and {r["_pieces"] for r in hot.select("_pieces").distinct().collect()} == {2}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = split_join(rows, table, ["k"], sizes, hot_rows=5)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert joined in plan and "_piece" in plan
        assert got.count() == rows.count() and got.where("w = 2 * k").count() == rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert shared_root(spark) == named.rstrip("/")
    else:
        assert shared_root(spark) == spark.sparkContext.getCheckpointDir()
