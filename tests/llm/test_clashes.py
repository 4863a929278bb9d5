"""Extra columns with the names that operators use inside, and results that don't depend on partitions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stagecast.llm import hmm_lm, quality, queries, shingles, substring_dedup, url_filter

WORDS = " ".join(f"word{k}" for k in range(30))


def named(spark, columns, rows):
    """Rows with all other columns holding their own name."""
    frame = spark.createDataFrame(rows)
    return frame.select("*", *[F.lit(c).alias(c) for c in columns])


def test_url_filter(spark):
    extra = ["_features", "_grams", "_ruled", "_judged", "_raw", "_label", "_page", "host", "label"]
    pages = named(spark, extra, [(k, f"http://{h}/{p}") for k, (h, p) in enumerate([("a.net", "x"), ("example.org", "fr/y"), ("b.com", "z"), ("c.net", "fr")])]).toDF(
        "page_id", "url", *extra)
    got = url_filter.filter_urls(pages, queries.URL_RULES)
    assert got.columns == ["page_id", "url", *[c for c in extra if c != "host"], "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in extra if c != "host") and {r.host for r in rows} == {"a.net", "example.org", "b.com", "c.net"}


def test_equally_long_rules_and_the_first_among_them():
    """Of rules of one length the first counts."""
    rules = [("block", "ab.de/"), ("allow", "cd.de/"), ("allow", "ab.de/"), ("block", "x.ab.de/")]
    assert sorted(rules, key=lambda r: -len(r[1]))[0][1] == "x.ab.de/"


@pytest.mark.parametrize("first", ["block", "allow"])
def test_two_rules_for_one_place(spark, first):
    other = {"block": "allow", "allow": "block"}[first]
    pages = spark.createDataFrame([(1, "http://ab.de/q")], "page_id long, url string")
    got = url_filter.filter_urls(pages, [(first, "ab.de/"), (other, "ab.de/")], url_filter.UrlFilter(None)).first()
    assert (got.rule, got.verdict) == ("ab.de/", first)


def test_quality(spark):
    extra = ["_text", "_words", "_lines", "_sorted", "_at", "_twice", "_row", "w"]
    docs = named(spark, extra, [(1, WORDS), (2, WORDS + " " + WORDS), (3, None)]).toDF("doc_id", "text", *extra)
    rows = {r.doc_id: r for r in quality.ledger(docs).collect()}
    assert all(r[c] == c for r in rows.values() for c in extra)
    assert (rows[1].n_words, rows[1].n_repeat_words, rows[2].n_repeat_words, rows[3].n_words) == (30, 0, 60, 0)


def test_ablations_count_each_rule(spark):
    docs = spark.createDataFrame([(1, "few words"), (2, WORDS + " " + WORDS), (3, "a " * 100), (4, " ".join(f"Word {k}, and that" for k in range(90)))], "doc_id long, text string")
    rows = quality.ledger(docs)
    held = [r.failed for r in rows.collect()]
    for policy in ("base", "v1"):
        wanted = quality.mask(policy)
        got = {r.rule: (r.n_failed, r.n_only_this, r.n_rejected) for r in quality.ablations(rows, policy).collect()}
        for bit, rule in enumerate(quality.RULES):
            if wanted >> bit & 1:
                hits = [f & wanted for f in held]
                assert got[rule] == (sum(h >> bit & 1 for h in hits), sum(h == 1 << bit for h in hits), sum(h != 0 for h in hits))


def test_substring_dedup(spark):
    extra = ["doc", "hash", "__hash", "__doc", "starts", "row", "n_words", "odd name"]
    docs = named(spark, extra, [(2, f"later {WORDS} end"), (1, WORDS), (None, WORDS), (1, WORDS), (3, None)]).toDF("doc_id", "text", *extra)
    got = substring_dedup.remove_repeats(docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", *[c for c in extra if c != "n_words"], "n_words", "n_removed", "kept_text"]
    assert all(r[c] == c for r in rows for c in extra if c != "n_words") and len(rows) == 5
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in rows) == [
        (0, 30, 0, WORDS), (1, 30, 0, WORDS), (1, 30, 0, WORDS), (2, 32, 30, "later end"), (3, 0, 0, "")
    ]


def test_slot_counts_stop_at_the_largest(spark, monkeypatch):
    """Counts beyond 32 bits must not begin anew at 0, which would hide a repeated token."""
    import numpy as np

    class Rows:
        """What has one token very often, in tasks of 2**31 each."""

        def mapInArrow(self, count, schema):
            import pyarrow as pa
            gaps, n = np.array([5], "<u4").tobytes(), np.array([1 << 31], "<u4").tobytes()
            return spark.createDataFrame([(0, 4, gaps, n)] * 2 + [(1, 4, gaps, n)], schema)

    counts = shingles.slot_summary(Rows(), None, 12, lambda c: c.copy())
    assert counts[5] == 0xFFFFFFFF and counts[64 + 5] == 1 << 31 and counts.sum(dtype=np.uint64) == 0xFFFFFFFF + (1 << 31)


def test_hmm_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"), (F.col("doc_id") % 10 == 0).alias("held"))
    scores = [
        {r.doc_id: r.score for r in hmm_lm.score(docs.repartition(n), "held", warm_texts=200, warm_rounds=2, rounds=1).collect()} for n in (2, 7)
    ]
    assert scores[0] == pytest.approx(scores[1], rel=1e-3)


def test_warm_rounds_take_every_training_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} river{i % 11} stone{i} word{i % 7}", i % 10 == 0) for i in range(300)], "doc_id long, text string, held boolean")
    taken, learn = [], hmm_lm.baum_welch
    monkeypatch.setattr(hmm_lm, "baum_welch", lambda texts, *rest: (taken.append(texts.count()), learn(texts, *rest))[1])
    hmm_lm.score(docs, "held", warm_rounds=5, rounds=1)
    assert sum(taken[:5]) == 270 and max(taken[:5]) < 270 and taken[5] == 270


def test_a_stored_slot_table_is_what_the_summary_would_be(spark):
    """The table of op4 stays with the tasks: 64 MB of it took the driver beyond its memory."""
    import numpy as np

    from stagecast.workspace import fresh_dir

    rows = spark.range(5000).repartition(3)
    held = lambda batch: (batch.column("id").to_numpy() % 700).astype(np.uint64) << np.uint64(54)
    table = shingles.SlotTable.of(rows, held, 12, lambda c: c.astype(np.uint8), fresh_dir(spark, "slots"))
    want = shingles.slot_summary(rows, held, 12, lambda c: c.astype(np.uint8))
    read = lambda batches: (pa.RecordBatch.from_arrays([pa.array([table.read().tobytes()])], ["t"]) for _ in batches)
    assert want.sum() > 0 and {bytes(r.t) for r in rows.mapInArrow(read, "t binary").collect()} == {want.tobytes()}
    empty = shingles.SlotTable.of(rows.where("id < 0"), held, 12, lambda c: c.astype(np.uint8), fresh_dir(spark, "slots"))
    assert not empty.read().any() and len(empty.read()) == 4096
