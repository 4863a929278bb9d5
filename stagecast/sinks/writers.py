"""Sinks: partitioned tables, CSV exports, GeoJSON lines."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecast.operators.ensemble import unpacked
from stagecast.sinks.loads import LoadedTable
from stagecast.tables import Tables, ensemble_table, observed_table, records_table, simulation_table
from stagecast.workspace import mark, materialise, release, shuffles_end_with_writes

_NTZ = "yyyy-MM-dd HH:mm:ss"


def write_partitioned(df: DataFrame, path: str, partition: str, cluster: str, mode: str = "append") -> None:
    """Write by ``partition``, rows of one ``cluster`` key near each other within the files.

    Rows are range-partitioned on partition, cluster and time, so a key with very many rows
    spreads over several files while the footers still let a keyed scan skip most of them.
    """
    (
        df.repartitionByRange(partition, cluster, "datetime")
        .sortWithinPartitions(partition, cluster, "datetime")
        .write.mode(mode).partitionBy(partition).parquet(path)
    )


def write_tables(tables: Tables, root: str) -> None:
    """Write the base tables in their stored layout; a second run replaces what it touches."""
    tables.station.write.mode("overwrite").parquet(f"{root}/station")
    observed_table(root).load(tables.observed, replace=True)
    simulation_table(root).load(tables.simulation, replace=True)
    ensemble_table(root).load(tables.ensemble, replace=True)
    records_table(root).load(tables.records, replace=True)


def upsert_runs(
    table: LoadedTable, rows: DataFrame, run: str, stream: str | None = None, batch: int | None = None
) -> bool:
    """Load forecast rows into the runs they belong to; ``run`` is the column that dates a run.

    The reaches among the rows replace what the run had of them; its other reaches stay. Loading
    the same rows again changes nothing. Of rows that repeat a moment and member the largest value
    stays.
    """
    spark, begun = rows.sparkSession, mark()
    if stream is not None and table.seen(spark, stream, batch):
        return False
    keys = [f.name for f in table.schema.fields if f.name != "value"]
    new = materialise(rows.groupBy(*keys).agg(F.max("value").alias("value")), "new-runs")
    touched = [tuple(r) for r in table.partitions_of(new).collect()]  # the runs of one delivery
    last = table.partition_columns[-1]
    before = table.rows(spark, F.col(last).isin(*[t[-1] for t in touched])) if touched else None
    loaded = new
    if before is not None:
        delivered = new.select(run, "reachid").distinct()
        loaded = new.unionByName(before.join(delivered, [run, "reachid"], "left_anti"))
    done = table.load(loaded, True, stream, batch)
    release(spark, begun)
    return done


def upsert_members(table: LoadedTable, moments: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
    """As :func:`upsert_runs` for ensemble rows that are stored in their packed form.

    One narrow row per member is only made while it is written: what is counted, shuffled and sorted
    are moments. Rows of reaches that were not delivered are copied only if there are any.
    """
    spark, begun, run = moments.sparkSession, mark(), "initialized"
    if stream is not None and table.seen(spark, stream, batch):
        return False
    texts = [F.expr(text) for _, text in table.partition]
    # The runs of one delivery.
    touched = [tuple(r) for r in moments.select(run).distinct().select(*texts).distinct().collect()]
    last = table.partition_columns[-1]
    delivered = materialise(moments.select(run, "reachid").distinct(), "delivered")
    stored = F.col(last).isin(*[t[-1] for t in touched])
    kept: set[tuple] = set()
    if touched:
        others = table.read(spark, stored).select(run, "reachid", *table.partition_columns).distinct().join(delivered, [run, "reachid"], "left_anti")
        kept = {tuple(r) for r in others.select(*table.partition_columns).distinct().collect()}

    def rows_of(part: tuple):
        own = moments
        for text, value in zip(texts, part):
            own = own.where(text.eqNullSafe(F.lit(value)))
        yield unpacked(own.repartitionByRange(*table.cluster).sortWithinPartitions(*table.cluster, "strip"))
        if part in kept:
            before = table.rows(spark, F.col(last) == part[-1]).join(delivered, [run, "reachid"], "left_anti")
            yield before.repartitionByRange(*table.cluster).sortWithinPartitions(*table.cluster)

    done = table.load_partitions(touched, rows_of, True, stream, batch)
    release(spark, begun)
    return done


def write_warnings(warnings: DataFrame, path: str) -> None:
    """Write warning rows; running a date again replaces that date only."""
    (
        warnings.withColumn("date", F.to_date("datetime"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date").parquet(path)
    )


def write_csv(df: DataFrame, path: str, key: str) -> None:
    """CSV with a header, one folder per key.

    Tasks move their files to their place themselves (algorithm 2 of the file committer): with a
    folder per key there are too many for the driver to move one after the other. A text key has
    Spark's name for a missing value instead of NULL, so the rows are not sorted a second time.

    In a folder of a file system that all tasks mount (``file:``) they write their files themselves,
    with the same names and content: there Hadoop starts several processes for each file to set
    permissions, which takes longer than all the rest.
    """
    if dict(df.dtypes)[key] == "string":
        df = df.withColumn(key, F.coalesce(F.when(F.col(key) != "", F.col(key)), F.lit(_NO_KEY)))
    placed, spark = df.repartitionByRange(key, "datetime").sortWithinPartitions(key, "datetime"), df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with shuffles_end_with_writes(spark):
        if files.getUri().getScheme() != "file":
            (
                placed.write.option("header", True).option("timestampNTZFormat", _NTZ)
                .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
                .partitionBy(key).csv(path)
            )
            return
        if files.exists(place):
            raise FileExistsError(f"{path} already exists")
        files.mkdirs(place)
        columns = [c for c in df.columns if c != key]
        line = lambda *values: F.to_csv(F.struct(*values), {"timestampNTZFormat": _NTZ})
        header = spark.range(1).select(line(*[F.lit(c).alias(c) for c in columns])).first()[0]
        rows = placed.select(F.coalesce(F.col(key).cast("string"), F.lit(_NO_KEY)).alias("key"), line(*columns).alias("line"))
        folders = files.makeQualified(place).toUri().getPath()
        rows.mapInArrow(_folder_writer(folders, key, header), "files long").agg(F.sum("files")).collect()
        files.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")).close()


_NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a key, as Spark names it
#: What Spark escapes in the name of a partition's folder.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def _folder_writer(folders: str, key: str, header: str):
    """Writes sorted lines (key, line) to a file per key and task, each in the folder of its key.

    A task that runs again writes the same files again.
    """
    write_id = uuid.uuid4()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, current, out, n = f"part-{TaskContext.get().partitionId():05d}-{write_id}.csv", None, None, 0
        try:
            for batch in batches:
                runs, start = pc.run_end_encode(batch.column("key")), 0
                for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if value != current:
                        if out is not None:
                            out.close()
                        folder = f"{folders}/{key}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value)}"
                        os.makedirs(folder, exist_ok=True)
                        out, current, n = open(f"{folder}/{name}", "w", encoding="utf-8", newline=""), value, n + 1
                        out.write(f"{header}\n")
                    out.write("\n".join(batch.column("line").slice(start, end - start).to_pylist()) + "\n")
                    start = end
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return write


def write_stations(station: DataFrame, path: str) -> None:
    """Station list as tab-separated text."""
    station.write.option("header", True).option("sep", "\t").csv(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """GeoJSON, one feature per line."""
    features.select("feature").write.text(path)


def write_collection(lines: DataFrame, path: str) -> None:
    """The lines of :func:`stagecast.operators.alerts.collection_lines` as ordered part files.

    Read in the order of their names the files are one JSON document; see :func:`join_parts`.
    """
    lines.orderBy("place", "hydroweb", "feature", "copy").select("line").write.text(path)


def join_parts(spark: SparkSession, path: str, target: str) -> None:
    """One file from the part files of a folder, in the order of their names.

    The file system appends them block by block: nothing but a buffer is held at a time.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, out = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    files = source.getFileSystem(conf)
    parts = sorted(str(f.getPath()) for f in files.listStatus(source) if f.getPath().getName().startswith("part-"))
    written = out.getFileSystem(conf).create(out, True)
    try:
        for part in parts:
            opened = files.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, written, 1 << 20, False)
            finally:
                opened.close()
    finally:
        written.close()
