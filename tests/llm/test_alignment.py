"""Alignment against a plain count of all links; the bitmaps against sets."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stagecast.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, container string, docs string, pair long, known boolean"
TEXTS = [
    None, "", " ", "  ", "\n", "one", "one", "two  words\n\n\nand three ", "a\t  b\r\n\rx <|endoftext|> <s> </s> <0x41> 　z  q  ",
    ";\r\n);\r {\r a\r\n  b", "x" * 3000 + " y\x1c \x85q​ ﻿", "naïve café 日本語 🙂 ﬁne ½ ́e", "▁ ▁▁x a▁b", "it's we'll I'd 'tis  's",
    " ".join(f"w{k % 97}x{k % 89}" for k in range(9000)),
]


def plain(texts):
    """The contract, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if all(c in alphabet for c in t)}
    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append((0, 0, 0, [], ""))
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left = [a_bytes[i] for i in x]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            found.append((0, 0, 0, [], ""))
            continue
        left, right = np.cumsum([0, *map(len, left)]), np.cumsum([0, *map(len, right)])
        links = []
        for i in range(len(x)):
            j = max(0, int(np.searchsorted(right, left[i], "right")) - 1)
            while j < len(y) and right[j] < left[i + 1]:
                links.append((x[i], y[j]))
                j += 1
        cuts = sorted(set(left.tolist()) & set(right.tolist()))
        groups = []
        for s, e in zip(cuts, cuts[1:]):
            parts = [ids[np.searchsorted(at, s) : np.searchsorted(at, e)] for ids, at in ((x, left), (y, right))]
            groups.append("|".join(",".join(map(str, p)) for p in parts))
        counts.update(links)
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), digest)
        for n_a, n_b, n_groups, links, digest in found
    ], counts


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return TEXTS + [r.text for r in docs]


@pytest.fixture(scope="module")
def frame(spark, texts):
    ids = [None if k == 5 else 1 if k in (6, 7) else k for k in range(len(texts))]
    return ids, spark.createDataFrame([(i, t, "clash", "clash", 1, True) for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def key(row):
    return tuple((v is None, v or 0) if k == 0 else v for k, v in enumerate(row))


def test_every_document(spark, texts, frame, monkeypatch):
    ids, df = frame
    want, _ = plain(texts)
    got = alignment.align_corpus(df, A, B)
    assert got.columns[1:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *w) for i, w in zip(ids, want)), key=key)


def test_counts_of_pairs(spark, texts, frame):
    _, counts = plain(texts)
    size = alignment.tokenizers(A, B).b_size
    rows = alignment.pair_counts(alignment.containers(frame[1], A, B), size).collect()
    assert {(r.pair // size, r.b_id): r.links for r in rows} == dict(counts)
    assert all(1 <= r.docs <= r.links for r in rows)
    assert {r.b_id for r in rows if r.best} == {j for _, j in counts}


def test_small_containers_give_the_same(texts):
    """Containers closed early, and a memory that is cleared all the time."""
    both = alignment.Tokenizers(A, B)
    want = both.documents([t or "" for t in texts])
    limit, alignment.REMEMBERED_CHARS = alignment.REMEMBERED_CHARS, 50
    try:
        for k, text in enumerate(texts):
            stats, digests, _, pairs = both.documents([text or ""])
            assert (stats[0] == want[0][k]).all() and digests[0] == want[1][k] and sorted(pairs) == sorted(want[3][want[2] == k])
    finally:
        alignment.REMEMBERED_CHARS = limit


def test_bitmaps_are_sets_with_multiplicities():
    rng = np.random.default_rng(4)
    parts = [(rng.integers(a, a + 2000, 5000), rng.integers(0, 40, 5000) ** 3) for a in (0, 2000, 6000)]
    maps = [alignment.Bitmaps.of_links(slots, pairs) for slots, pairs in parts]
    merged = alignment.Bitmaps.unpacked(maps[0].merged(maps[1]).merged(maps[2]).packed())
    links = Counter((int(p), int(s)) for slots, pairs in parts for s, p in zip(slots, pairs))
    pairs, docs, n = merged.counts()
    assert pairs.tolist() == sorted({p for p, _ in links})
    assert docs.tolist() == [sum(1 for q, _ in links if q == p) for p in pairs.tolist()]
    assert n.tolist() == [sum(v for (q, _), v in links.items() if q == p) for p in pairs.tolist()]
    weights = rng.integers(0, 1 << 40, len(pairs))
    total = np.zeros(alignment.CONTAINER_DOCS, np.int64)
    for (p, s), v in links.items():
        total[s] += v * weights[np.searchsorted(pairs, p)]
    assert (merged.summed(pairs, weights) == total).all()
    none = alignment.Bitmaps.unpacked(alignment.Bitmaps.of_links(np.zeros(0, np.int64), np.zeros(0, np.int64)).packed())
    assert none.counts()[0].size == 0 and not none.summed(pairs, weights).any()


def test_no_documents(spark, frame):
    assert alignment.align_corpus(frame[1].where("false"), A, B).count() == 0
