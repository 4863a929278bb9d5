"""The stages on a small table: what each keeps, and that its decisions take effect."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
            assert 0 < docs.count() <= before.count()
            texts.append({r.doc_id: r.text for r in docs.collect()})
    rules, exact, near, cut = texts
    assert len(set(rules.values())) == len(exact) == len(set(exact.values()))
    assert set(exact) >= set(near) == set(cut)
    first = {}
    for d in sorted(near):
        w = near[d].split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, text in near.items():
        w = text.split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        assert cut[d] == (" ".join(x for j, x in enumerate(w) if j not in gone) if gone else text)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in cut.items()}
    assert {r.doc_id: r.n for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want


def test_nothing_comes_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_packing_leaves_no_table_of_other_stages_in_its_worker(spark, monkeypatch):
    """A worker outlives its task: what it has freed goes back to the system, tables of earlier stages go."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from stagecast.llm import packing, shingles

    tasks, tidied = [], []
    rows = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, function, schema: tasks.append(function) or df)
    packing.pieces(rows, public_tokenizers.path("word_bpe_49k.json"), 2048, 1, "doc_id", "text")
    monkeypatch.setitem(shingles._read, "folder", np.zeros(1))
    monkeypatch.setattr(packing, "tidy", lambda: tidied.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", None]})
    made = list(tasks[0](iter([batch])))
    assert made[0].num_rows == 2 and not shingles._read and tidied == [1]
