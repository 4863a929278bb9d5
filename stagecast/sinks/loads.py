"""Stored tables that are loaded again and again without repeating or losing rows.

A load writes its rows to folders of its own (``../load=<name>``) and then adds one row per
partition it touched to a small list of valid loads. Readers follow that list, so

* rows of a load that failed half-way are never seen, and running it again is safe;
* a load either replaces its partitions or adds to them; readers never see half of either;
* a streaming micro-batch that is delivered twice is recognised by its number and skipped.

The list has one row per load and partition, as many as Spark lists folders for the table anyway,
so it is read on the driver. One job at a time may load a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from stagecast.workspace import DENSE, shuffles_end_with_writes

LOAD = "load"
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a value, as Spark names it


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class LoadedTable:
    """A table below ``path`` with the data columns of ``schema``.

    ``partition`` maps the partition columns to column expressions over the data, as SQL text;
    ``cluster`` names the columns by which rows lie near each other within the files.
    """

    path: str
    schema: StructType
    partition: tuple[tuple[str, str], ...]
    cluster: tuple[str, ...]

    @property
    def partition_columns(self) -> list[str]:
        return [name for name, _ in self.partition]

    def _with_partition(self, rows: DataFrame) -> DataFrame:
        kept = rows.select(*[f.name for f in self.schema.fields])
        return kept.select("*", *[F.expr(text).cast("string").alias(name) for name, text in self.partition])

    def partitions_of(self, rows: DataFrame) -> DataFrame:
        """The distinct partitions of some rows."""
        return self._with_partition(rows).select(*self.partition_columns).distinct()

    def history(self, spark: SparkSession) -> DataFrame:
        """All loads: partition columns, load, number, replaces, stream, batch."""
        columns = ", ".join(f"{c} string" for c in self.partition_columns)
        schema = f"{columns}, {LOAD} string, number long, replaces boolean, stream string, batch long"
        if not _exists(spark, f"{self.path}/loads"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/loads")

    def valid_loads(self, spark: SparkSession, where: Column | None = None) -> list[str]:
        """Loads that make up the table: of each partition the last replacing one and what follows it."""
        listed = self.history(spark)
        if where is not None:
            listed = listed.where(where)
        rows = listed.collect()
        last: dict[tuple, int] = {}
        for r in rows:
            key = tuple(r[c] for c in self.partition_columns)
            if r["replaces"]:
                last[key] = max(last.get(key, -1), r["number"])
        return sorted(r[LOAD] for r in rows if r["number"] >= last.get(tuple(r[c] for c in self.partition_columns), -1))

    def read(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        """Valid rows, with the partition columns; ``where`` is over those and skips folders."""
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields]
        fields += [f"{c} string" for c in [*self.partition_columns, LOAD]]
        loads = self.valid_loads(spark, where)
        if not loads:
            return spark.createDataFrame([], ", ".join(fields)).drop(LOAD)
        rows = spark.read.schema(", ".join(fields)).parquet(f"{self.path}/data").where(F.col(LOAD).isin(*loads))
        return (rows if where is None else rows.where(where)).drop(LOAD)

    def rows(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        """Valid rows, data columns only."""
        return self.read(spark, where).select(*[f.name for f in self.schema.fields])

    def seen(self, spark: SparkSession, stream: str, batch: int) -> bool:
        """Whether a micro-batch has been loaded."""
        return not self.history(spark).where((F.col("stream") == stream) & (F.col("batch") >= batch)).isEmpty()

    def load(self, rows: DataFrame, replace: bool, stream: str | None = None, batch: int | None = None) -> bool:
        """Load rows; with ``replace`` they are all there is in the partitions they touch.

        ``stream`` and ``batch`` number a micro-batch; one that is known changes nothing (False).
        """
        spark = rows.sparkSession
        if stream is not None and self.seen(spark, stream, batch):
            return False
        number, name = self._next(spark)
        parts = self.partition_columns
        placed = self._with_partition(rows).withColumn(LOAD, F.concat_ws("-", F.lit(name), *parts))
        order = [*parts, *self.cluster]
        with shuffles_end_with_writes(spark):
            (
                placed.repartitionByRange(*order).sortWithinPartitions(*order)
                .write.mode("append").option("compression", DENSE).partitionBy(*parts, LOAD).parquet(f"{self.path}/data")
            )
        fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields), *(f"{c} string" for c in [*parts, LOAD])])
        # Partition columns only: no data column is read.
        written = spark.read.schema(fields).parquet(f"{self.path}/data").where(F.col(LOAD).startswith(name)).select(*parts, LOAD).distinct()
        self._list(written.select(*parts, LOAD), number, replace, stream, batch)
        return True

    def load_partitions(
        self, partitions: Sequence[tuple], rows_of: Callable[[tuple], Iterable[DataFrame]], replace: bool,
        stream: str | None = None, batch: int | None = None,
    ) -> bool:
        """As :meth:`load`, for few partitions that are known beforehand (values in the order of the
        partition columns): each is written into its own folder.

        ``rows_of`` gives the rows of a partition in one or more frames of the data columns. They are
        written as they lie, so what expands them may follow their sort: rows of one folder need no
        second sort by partition.
        """
        if not partitions:
            return True
        spark, columns, listed = None, [f.name for f in self.schema.fields], []
        number = name = None
        for part in partitions:
            for rows in rows_of(part):
                if spark is None:
                    spark = rows.sparkSession
                    if stream is not None and self.seen(spark, stream, batch):
                        return False
                    number, name = self._next(spark)
                load = "-".join([name, *(v for v in part if v is not None)])
                folder = "/".join(f"{c}={_NO_VALUE if v is None else v}" for c, v in zip([*self.partition_columns, LOAD], [*part, load]))
                with shuffles_end_with_writes(spark):
                    rows.select(*columns).write.mode("append").option("compression", DENSE).parquet(f"{self.path}/data/{folder}")
            listed.append((*part, load))
        schema = ", ".join(f"{c} string" for c in [*self.partition_columns, LOAD])
        self._list(spark.createDataFrame(listed, schema), number, replace, stream, batch)
        return True

    def _next(self, spark: SparkSession) -> tuple[int, str]:
        """Number and name of a new load."""
        number = (self.history(spark).agg(F.max("number")).first()[0] or 0) + 1
        return number, f"{number:08d}-{uuid.uuid4().hex[:12]}"

    def _list(self, written: DataFrame, number: int, replace: bool, stream: str | None, batch: int | None) -> None:
        """Add what a load has written to the list of valid loads."""
        listed = written.select(
            "*", F.lit(number).cast("long").alias("number"), F.lit(replace).alias("replaces"),
            F.lit(stream).cast("string").alias("stream"), F.lit(batch).cast("long").alias("batch"),
        )
        with shuffles_end_with_writes(written.sparkSession):
            listed.coalesce(1).write.mode("append").parquet(f"{self.path}/loads")  # one file: all partitions or none

    def remove_superseded(self, spark: SparkSession) -> int:
        """Delete folders that no reader follows any more; returns how many. Not while readers run."""
        valid = set(self.valid_loads(spark))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        gone = [r for r in self.history(spark).collect() if r[LOAD] not in valid]
        for r in gone:
            place = hadoop("/".join([f"{self.path}/data", *(f"{c}={r[c]}" for c in self.partition_columns), f"{LOAD}={r[LOAD]}"]))
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return len(gone)
