"""A training corpus from the documents table: filter, deduplicate three ways, pack.

Each stage takes what the one before it kept, written as Parquet and read again, so a stage may
remove the scratch tables of earlier ones. All stages but the last return the columns of documents.

Packing has no single right result, and near-duplicate groups are connected components, so SQL
doesn't express the whole; ``ORACLE_SQL`` is None and tests compare stages with brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecast.llm import exact_dedup, jaccard_join, packing, quality, substring_dedup
from stagecast.llm.common import mark, release
from stagecast.workspace import shared_root

ORACLE_SQL = None

_scratch: dict[str, list[tuple[int, int]]] = {}


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the scratch tables of the stages before it, which are written by now."""

    @wraps(function)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = _scratch.setdefault(spark.sparkContext.applicationId, [])
        if function.__name__ != "quality_rules":  # the first one may follow an unread result of another run
            for since, until in held:
                release(spark, since, until)
        held.clear()
        begun = mark()
        result = function(spark, docs, sf_dir)
        held.append((begun, mark()))
        return result

    return call


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))
    return quality.ledger(rows).where(~quality.fails("base") & ~quality.fails("v1")).select("_doc.*")


@_stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier."""
    return exact_dedup.distinct_texts(docs, keep="largest")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the smallest identifier."""
    return jaccard_join.one_of_each_group(docs, shingle_words=5, num=80, den=100)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 13 words that a document with a smaller identifier has.

    A text that loses nothing stays as it is; another is its remaining words, joined by a space.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    cut = substring_dedup.remove_repeats(docs.select(F.struct(*others).alias("_doc"), "doc_id", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("_doc")["n_chars"])}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col("_doc")[c].alias(c) for c in docs.columns])


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs, root = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(result.schema).parquet(f"{root}/{name}")
    return docs


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracles() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
