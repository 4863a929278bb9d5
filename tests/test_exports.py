import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stagecast.fixtures import StoredFixtures
from stagecast.sinks import writers
from stagecast.sources import readers
from verification import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Driver tables of four stations on two reaches, with two years of readings."""
    path = str(tmp_path_factory.mktemp("tables"))
    for name, sql in {
        "supplier": "SELECT id AS s_suppkey, concat('S', id) AS s_name, 1 AS s_nationkey, 2.5D AS s_acctbal FROM range(2, 6)",
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey", "region": "SELECT 1 AS r_regionkey, 'R' AS r_name",
        "lineitem": "SELECT timestampadd(DAY, CAST(id % 700 AS INT), TIMESTAMP_NTZ'2000-01-01 00:00:00') AS l_shipdate, 2 + id % 4 AS l_suppkey, "
                    "CAST(id * 7 % 50 AS DOUBLE) AS l_quantity, CAST(id * 7919 % 90000 AS DOUBLE) AS l_extendedprice FROM range(2800)",
    }.items():
        spark.sql(sql).write.parquet(f"{path}/{name}.parquet")
    return path


def unused(name):
    return property(lambda self: pytest.fail(f"{name} is not read by the query"))


def test_loads_derive_only_what_they_load(spark, folder, monkeypatch):
    for name in ("_observed", "_simulation"):
        monkeypatch.setattr(StoredFixtures, name, unused(name))
    queries._contexts.pop((spark.sparkContext.applicationId, folder), None)
    try:
        rows = queries.registry()["forecast_load"](spark, folder).collect()
    finally:
        queries._contexts.pop((spark.sparkContext.applicationId, folder), None)
    assert len(rows) == 3 * 2 * 120 and {r.n_rows for r in rows} == {52}
    # Member 7 has a gap in every 40 steps.
    assert sorted({(r.n_members or 0) for r in rows}) == [0, 51] and sum(r.n_members is None for r in rows) == 3 * 2 * 3


def test_corrected_export_stores_no_forecast(spark, folder, monkeypatch):
    monkeypatch.setattr(StoredFixtures, "_ensemble", unused("_ensemble"))
    queries._contexts.pop((spark.sparkContext.applicationId, folder), None)
    try:
        rows = queries.registry()["export_corrected_sim"](spark, folder)
        simulated = queries.context(spark, folder).past.simulation.count()
        assert rows.count() == 2 * simulated and rows.where("corrected IS NULL").count() == 0
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        queries._contexts.pop((spark.sparkContext.applicationId, folder), None)


T0 = dt.datetime(2001, 2, 3, 4, 5, 6)
TEXTS = [("a=b/c%d", 'q"uo,te\nline'), ("é Ω", ""), ("", "x"), (None, None), ("~ [1]{2}^", " y "), ("HW-1", "z"), ("HW-1", None)]


@pytest.mark.parametrize("key, kind", [("name", "string"), ("number", "int"), ("day", "date")])
def test_export_is_what_spark_writes(spark, tmp_path, key, kind):
    """The same folders, and the same lines in them, whatever the key holds."""
    rows = [(None if i == 5 else T0 + dt.timedelta(days=i), n, t, None if i == 2 else i * 1e-7 - 3e8, None if i == 4 else i % 3) for i, (n, t) in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "datetime timestamp_ntz, name string, text string, value double, number int").withColumn("day", F.to_date("datetime"))
    mine, plain = str(tmp_path / "mine"), str(tmp_path / "plain")
    writers.write_csv(frame, mine, key)
    frame.coalesce(1).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").partitionBy(key).csv(plain)

    def lines(root):
        found = {}
        for place, _, names in os.walk(root):
            for name in (n for n in names if n.endswith(".csv")):
                with open(f"{place}/{name}", newline="") as f:
                    head, _, text = f.read().partition("\n")
                found.setdefault((os.path.relpath(place, root), head), []).append(text)
        return {k: sorted("".join(v).split("\n")) for k, v in found.items()}

    assert lines(mine) == lines(plain) and os.path.exists(f"{mine}/_SUCCESS")
    # Written by tasks themselves: Hadoop's local files have sums beside them.
    assert not [n for _, _, names in os.walk(mine) for n in names if n.startswith(".part")]
    with pytest.raises(FileExistsError):
        writers.write_csv(frame, mine, key)


def test_an_export_of_many_keys_is_read_in_few_tasks(spark, tmp_path):
    rows = spark.range(150).selectExpr("concat('K', id) AS hydroweb", "TIMESTAMP_NTZ'2001-01-01 00:00:00' AS datetime", "CAST(id AS DOUBLE) AS level")
    writers.write_csv(rows, str(tmp_path / "out"), "hydroweb")
    got = readers.read_export(spark, str(tmp_path / "out"), "datetime timestamp_ntz, level double, hydroweb string")
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert got.select("hydroweb", "datetime", "level").exceptAll(rows).count() == 0 and got.count() == 150
