"""What the operators of this subpackage share: words, shipping of code, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import io
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stagecast.workspace import fresh_dir, mark, materialise, release

__all__ = ["BATCH_ROWS", "NOT_SPACE", "WORD", "fresh_dir", "grouped_rows", "lower_az", "mark", "materialise", "ready", "release", "text_of", "tidy", "words_of"]

#: Words are runs of anything but the six ASCII white-space characters.
NOT_SPACE = r"[^\x20\x09-\x0D]"
WORD = re.compile(NOT_SPACE + "+")

#: Rows of one Arrow batch at most: a batch of whole texts has to fit a Python worker.
BATCH_ROWS = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Prepare a session for the Python parts: the package on every executor, bounded batches.

    The package is sent as a zip file once per application, so executors need no copy of it.
    A setting of fewer rows per batch is respected.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, f"{package.name}/{file.relative_to(package)}")
        target = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}_tasks.zip"
        target.write_bytes(held.getvalue())
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark


def text_of(column: str | Column) -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_az(column: Column) -> Column:
    """A-Z in lower case and nothing else, unlike ``lower``."""
    return F.translate(column, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NOT_SPACE}+)"), F.lit(1))


def tidy() -> None:
    """Give memory that tasks of this process have freed back to the system.

    A Python worker outlives its task, and what it keeps counts beside the next stage of its executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def lowered(text: str) -> str:
    return text.translate(_TO_LOWER)


def grouped_rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, ...]]:
    """Columns of each batch as Python lists; empty batches are skipped."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(c).to_pylist() for c in columns)
