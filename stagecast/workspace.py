"""Scratch and intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Codec of large tables: doubles take about half of what Spark's default leaves of them.
DENSE = "zstd"

_of_thread = threading.local()


def _made() -> list[str | None]:
    """Folders handed out to this thread so far, oldest first; None where they were removed.

    Micro-batches of several streams run in threads of their own, and none may remove what another
    still reads.
    """
    if not hasattr(_of_thread, "made"):
        _of_thread.made = []
    return _of_thread.made


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session of one process (``local[..]``) may go without the setting: it gets a temporary
    folder, which becomes its checkpoint folder. On a cluster every executor would write such a
    folder to its own disk, so that is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"{_SETTING} has to name a folder that all executors share (master {context.master})")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stagecast-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made().append(path)
    return path


@contextmanager
def shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """Writes made within remove their shuffle files when they end.

    Otherwise these stay until the driver happens to collect its garbage, and a job of many large
    writes holds the shuffles of all of them.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor only re-reads files, lets several consumers
    share one computation, and gives Catalyst the true size for its broadcast decision.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    with shuffles_end_with_writes(spark):
        (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, path: str) -> None:
    """Remove the files of a scratch folder that is used on; what it held has been read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(place, True)
    files.mkdirs(place)


def mark() -> int:
    """A point in this thread's sequence of scratch folders, for ``release``."""
    return len(_made())


def release(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Remove the scratch folders this thread made between two marks, once no unread result depends on them."""
    made = _made()
    for k in range(since, len(made) if until is None else until):
        if made[k]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made[k])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            made[k] = None
