import datetime as dt
import os
import time

import pytest

from stagecast.schemas import ENSEMBLE, OBSERVED
from stagecast.streaming import ingest
from stagecast.tables import daily_table, ensemble_table, readings_table, records_table

T0 = dt.datetime(2024, 1, 1)


def readings(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=h), s, v if v is None else float(v)) for h, s, v in rows], OBSERVED)


def put(spark, path, rows):
    readings(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_ingest_continues_from_its_checkpoint(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch in ([(0, "A", 1)], [(1, "A", 2), (1, "B", 3)]):
        put(spark, src, batch)
        ingest.drain(ingest.read_stream(spark, src, OBSERVED), out, state)
    assert sorted(r.waterlevel for r in spark.read.parquet(out).collect()) == [1.0, 2.0, 3.0]


def test_a_reading_is_stored_once_however_late(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    table, late = readings_table(str(tmp_path / "t")), readings_table(str(tmp_path / "late"))
    year = 24 * 366
    for batch in (
        [(0, "A", 1), (0, "A", 1), (0, "B", 5), (year, "A", 7)],
        [(0, "A", 1), (2, "A", 2), (year, "A", 7)],          # hour 2 comes a year late, the others again
        [(2, "A", 9), (year + 1, "B", None)],                  # a key that is stored keeps its level
    ):
        put(spark, src, batch)
        ingest.ingest_readings(ingest.read_stream(spark, src, OBSERVED), table, state, late, "2 days")
    got = sorted((r.hydroweb, r.datetime, r.waterlevel) for r in table.rows(spark).collect())
    at = {h: T0 + dt.timedelta(hours=h) for h in (0, 2, year, year + 1)}
    assert got == [("A", at[0], 1.0), ("A", at[2], 2.0), ("A", at[year], 7.0), ("B", at[0], 5.0), ("B", at[year + 1], None)]
    assert [(r.hydroweb, r.datetime) for r in late.rows(spark).collect()] == [("A", at[2])]


def test_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    table, daily = readings_table(str(tmp_path / "t")), daily_table(str(tmp_path / "d"))
    rows = readings(spark, [(0, "A", 1), (1, "A", 4)])
    assert ingest.store_readings(table, None, rows, "s", 3, "2 days") and ingest.store_daily_maximum(daily, rows, "s", 3)
    before = table.valid_loads(spark), daily.valid_loads(spark)
    assert not ingest.store_readings(table, None, rows, "s", 3, "2 days") and not ingest.store_daily_maximum(daily, rows, "s", 3)
    assert (table.valid_loads(spark), daily.valid_loads(spark)) == before
    assert table.rows(spark).count() == 2


def test_rows_of_a_load_that_was_never_listed_are_not_seen(spark, tmp_path):
    table = readings_table(str(tmp_path / "t"))
    table.load(readings(spark, [(0, "A", 1)]), replace=False)
    # What a job that died before its last step leaves behind.
    readings(spark, [(1, "A", 2)]).selectExpr("*", "'2024-01' AS month", "'99-dead' AS load").write.mode("append").partitionBy("month", "load").parquet(f"{table.path}/data")
    assert table.rows(spark).count() == 1


def test_replacing_adding_and_removing(spark, tmp_path):
    table = readings_table(str(tmp_path / "t"))
    table.load(readings(spark, [(0, "A", 1), (24 * 40, "A", 2)]), replace=True)
    table.load(readings(spark, [(1, "B", 3)]), replace=False)
    assert sorted(r.waterlevel for r in table.rows(spark).collect()) == [1.0, 2.0, 3.0]
    table.load(readings(spark, [(2, "C", 4)]), replace=True)      # January again, February stays
    assert sorted(r.waterlevel for r in table.rows(spark).collect()) == [2.0, 4.0]
    assert table.remove_superseded(spark) == 2
    assert sorted(r.waterlevel for r in table.rows(spark).collect()) == [2.0, 4.0]
    assert table.rows(spark).columns == OBSERVED.names
    assert readings_table(str(tmp_path / "never")).rows(spark).count() == 0


@pytest.mark.parametrize("files", [1, None])
def test_daily_maximum_is_complete_with_late_rows(spark, tmp_path, files):
    src, state, table = str(tmp_path / "in"), str(tmp_path / "state"), daily_table(str(tmp_path / "d"))
    first = [(h, s, (h * 7 + len(s)) % 23) for h in range(0, 24 * 6, 5) for s in ("A", "BB")]
    late = [(1, "A", 999), (24 * 8, "A", 0), (2, "C", None), (0, "A", 0)]     # hour 1 comes eight days late
    for batch in (first, late):
        put(spark, src, batch)
        ingest.ingest_daily_maximum(ingest.read_stream(spark, src, OBSERVED, files), table, state)
    want = {}
    for h, s, v in first + late:
        key = (s, (T0 + dt.timedelta(hours=h)).date())
        want[key] = max((float(x) for x in (want.get(key), v) if x is not None), default=None)
    got = {(r.hydroweb, r.day): r.max_level for r in table.rows(spark).collect()}
    assert got == want


def test_forecast_runs_arrive_in_parts_and_again(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    ensemble, records = ensemble_table(str(tmp_path / "e")), records_table(str(tmp_path / "r"))

    def arrive(run, reaches, value):
        start = T0 + dt.timedelta(days=run)
        rows = [(start + dt.timedelta(hours=6 * k), r, start, m, value + m) for r in reaches for k in range(2) for m in (1, 2)]
        spark.createDataFrame(rows, ENSEMBLE).coalesce(1).write.mode("append").parquet(src)
        ingest.ingest_forecasts(ingest.read_stream(spark, src, ENSEMBLE), ensemble, records, state)

    arrive(0, (10, 12), 0.0)
    arrive(0, (14,), 0.0)            # more reaches of the same run
    arrive(1, (10,), 5.0)
    arrive(0, (12,), 100.0)          # a reach of the first run again, with other values
    rows = ensemble.rows(spark).collect()
    assert len(rows) == 4 * 4 and len({(r.reachid, r.initialized, r.datetime, r.member) for r in rows}) == 16
    assert {r.value for r in rows if r.reachid == 12} == {101.0, 102.0}
    assert sorted((r.datetime.day, r.reachid, r.value) for r in records.rows(spark).collect()) == [
        (1, 10, 1.0), (1, 12, 101.0), (1, 14, 1.0), (2, 10, 6.0)
    ]


def test_scratch_of_another_thread_stays(spark):
    """Two streams at once: neither removes what the other is reading."""
    import threading

    from stagecast.workspace import mark, materialise, release

    begun, held = mark(), {}

    def other():
        held["table"] = materialise(spark.range(7), "other")

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    mine = materialise(spark.range(3), "mine")
    release(spark, begun)
    assert held["table"].count() == 7 and mark() == begun + 1
    with pytest.raises(Exception):
        mine.count()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffles_of_a_stored_table_go_with_its_write(spark, tmp_path):
    from stagecast.workspace import materialise

    rows = [(T0 + dt.timedelta(hours=h), h % 7, T0, m, float(h + m)) for h in range(50) for m in (1, 2)]
    frame, before = spark.createDataFrame(rows, ENSEMBLE), shuffle_files(spark)
    stored = materialise(frame.groupBy("reachid").count(), "counted")
    ensemble_table(str(tmp_path / "e")).load(frame, replace=True)
    for _ in range(50):  # files are removed in the background
        left = {name for name in shuffle_files(spark) - before if name.endswith(".data")}
        if len({name.split("_")[1] for name in left}) <= 1:
            break
        time.sleep(0.2)
    assert sorted(r["count"] for r in stored.collect()) == [14] * 6 + [16] and ensemble_table(str(tmp_path / "e")).rows(spark).count() == 100
    # Of three writes with a shuffle at most one small one may still be there.
    assert len({name.split("_")[1] for name in left}) <= 1, left


def test_arrivals_are_removed_once_they_are_stored(spark, tmp_path, monkeypatch):
    """The query never holds the files of two arrivals, and each arrival goes on from the checkpoint."""
    from verification import queries

    folder, places, seen = str(tmp_path / "tables"), {}, []
    for name, sql in {
        "supplier": "SELECT id AS s_suppkey, concat('S', id) AS s_name, 1 AS s_nationkey, 2.5D AS s_acctbal FROM range(2, 6)",
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey", "region": "SELECT 1 AS r_regionkey, 'R' AS r_name",
    }.items():
        spark.sql(sql).write.parquet(f"{folder}/{name}.parquet")
    plain, load = queries._Context.dir, ingest.ingest_forecasts
    monkeypatch.setattr(queries._Context, "dir", lambda c, label: places.setdefault(label, plain(c, label)))
    files = lambda: [f for f in os.listdir(places["arrivals"].removeprefix("file:")) if f.endswith(".parquet")]

    def stored(*given):
        seen.append(set(files()))
        load(*given)

    monkeypatch.setattr(ingest, "ingest_forecasts", stored)
    rows = queries.registry()["stream_forecast_ingest"](spark, folder)
    assert rows.count() == rows.distinct().count() == 3 * 2 * 120 * 52
    assert len(seen) == 4 and all(seen) and len(set.union(*seen)) == sum(map(len, seen)) and files() == []
