"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stagecast.llm import alignment, bpe, exact_dedup, hmm_lm, html_extract, jaccard_join, language_id, oracle, packing, prefix_trie, quality, substring_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    both = bpe.bpe_decode(ids, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


#: The rules that are in force: (verdict, host and path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, sf_dir, "documents"), shingle_words=4, num=85, den=100)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.fails("base").alias("base_failed"), (~quality.fails("base") & ~quality.fails("v1")).alias("kept"), "failed",
    )


def _crc(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_crc(10) == 0).alias("held_out"))
    return hmm_lm.score(docs, "held_out")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_crc(3) == 1).alias("held_out"))
    model = language_id.train(docs.where("NOT held_out"), vocabulary)
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model, vocabulary)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_crc(5) == 0).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_crc(5) != 0)
    model = toxicity.train(docs.where("NOT held_out"), labels, "toxic")
    return toxicity.score(docs, model).select(
        "doc_id", "held_out", "score", "predicted", F.col("evidence.doc_id").alias("nearest")
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_QUERIES = (op1_bpe, op2_exact_dedup, op3_url_filter, op4_jaccard_join, op5_hmm_score, op6_quality_rules, op7_language_id, op8_substring_dedup, op9_packing, op10_html_extract, op11_prefix_trie, op12_toxicity, op13_alignment)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def oracles() -> dict[str, str]:
    return dict(oracle.SQL)
