"""Exact deduplication by content sort.

1. Splitters are sampled: the start of the text and the identifier of some rows per part, sorted.
   The identifier is part of a splitter, so a text that a third of all rows share is cut into
   many parts instead of filling one.
2. Each row goes to the part its key falls into and every part is sorted by its whole texts; the
   sort is external and spills. Equal texts of a part are now neighbours.
3. Every row is compared in full with the row before it. A row that differs begins a run.
4. Runs, not rows, are joined across parts, by SHA-256 and length: a text has at most one run per
   part. Rows look up their own run, of which no part has more than its share.

Texts move once; afterwards rows are a few numbers and a digest. Everything is a DataFrame
operation on built-in functions.

Defined results: NULL counts as the empty text, and empty texts are equal to each other. If a row
is repeated with the same identifier, one of the repeats stays. A NULL identifier yields to any
other; a group with only NULL identifiers keeps one row and has a NULL ``keep_id``. An empty
table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecast.llm.common import materialise, text_of

#: Characters of a text that a splitter holds; splitters stay small however long texts are.
SPLITTER_CHARS = 64
#: Sampled keys for each part, from which every such-th becomes a splitter.
SAMPLED_PER_PART = 20


def splitters(rows: DataFrame, parts: int, seed: int = 7) -> str:
    """JSON array of at most ``parts`` - 1 ascending keys (k: start of the text, i: identifier)."""
    total = rows.count()
    share = min(1.0, parts * SAMPLED_PER_PART / max(total, 1))
    keys = rows.select(F.substring("_text", 1, SPLITTER_CHARS).alias("k"), F.col("_id").alias("i"))
    sampled = keys.sample(share, seed).orderBy("k", "i").collect()
    every = max(1, len(sampled) // parts)
    return json.dumps([{"k": r.k, "i": r.i} for r in sampled[every::every]][: parts - 1])


def part_of(split: str, n: int, id_type: str) -> Column:
    """How many of the ``n`` splitters lie at or before a row's key, found by binary search."""
    table = F.from_json(F.lit(split), f"array<struct<k:string,i:{id_type}>>")
    key = F.struct(F.substring("_text", 1, SPLITTER_CHARS).alias("k"), F.col("_id").alias("i"))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length() or 1))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at),
    )


def _compared(rows: DataFrame, keep: str) -> tuple[DataFrame, Window]:
    """Rows (_id, _text, ..) in sorted parts, with _new (differs from the row before) and the order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = splitters(rows, parts)
    dealt = rows.withColumn("_part", part_of(split, len(json.loads(split)), dict(rows.dtypes)["_id"])).repartitionById(
        parts, F.col("_part")
    )
    first = F.desc_nulls_last("_id") if keep == "largest" else F.asc_nulls_last("_id")
    order = Window.partitionBy("_part").orderBy("_text", first)
    before = F.lag("_text").over(order)
    return dealt.withColumn("_new", before.isNull() | (before != F.col("_text"))), order


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(normalise(text_of(text_col))).alias("_text"))
    compared, order = _compared(rows, keep)
    again = ~F.col("_new") & F.col("_id").eqNullSafe(F.lag("_id").over(order))
    runs = F.sum(F.col("_new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = materialise(
        compared.select(
            "_id", "_part", runs.alias("_run"), again.alias("_again"), F.sha2("_text", 256).alias("text_sha256"),
            F.octet_length("_text").alias("_bytes"),
        ),
        "sorted-runs",
    )
    best = F.max if keep == "largest" else F.min
    run = marked.groupBy("_part", "_run").agg(
        F.first("text_sha256").alias("_sha"), F.first("_bytes").alias("_bytes"), best("_id").alias("_keep"), F.count("*").alias("_n")
    )
    whole = run.groupBy("_sha", "_bytes").agg(best("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    stitched = run.select("_part", "_run", "_sha", "_bytes").join(whole, ["_sha", "_bytes"])
    return marked.join(stitched.select("_part", "_run", "keep_id", "group_size"), ["_part", "_run"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & ~F.col("_again")).alias("kept"), "text_sha256",
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row for each text, all columns kept.

    The first row of a run is the part's best; of texts cut by a splitter only the best part's
    row stays. NULL and the empty text are equal, and the row that stays keeps its own.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"),
        F.col(text_col).isNull().alias("_null"),
    )
    compared, _ = _compared(rows, keep)
    firsts = materialise(
        compared.where("_new").select("_row", "_id", "_null", "_text", "_part", F.sha2("_text", 256).alias("_sha"), F.octet_length("_text").alias("_bytes")),
        "sorted-texts",
    )
    best = F.max if keep == "largest" else F.min
    heads = firsts.select("_sha", "_bytes", "_part", "_id")
    cut = heads.groupBy("_sha", "_bytes").agg(best("_id").alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    losers = heads.join(cut, ["_sha", "_bytes"]).where(~F.col("_id").eqNullSafe(F.col("_best"))).select("_sha", "_bytes", "_part")
    kept = firsts.join(losers, ["_sha", "_bytes", "_part"], "left_anti")
    text = F.when(~F.col("_null"), F.col("_text")).alias(text_col)
    return kept.select("_row.*", text).select(*[F.col(f"`{c}`") for c in docs.columns])
