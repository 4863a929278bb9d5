"""Each query against brute force, over a small table of awkward rows and the smallest documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from stagecast.llm import html_extract, jaccard_join, queries
from stagecast.llm.hmm_lm import initial, log_likelihood
from stagecast.llm.packing import best_fit_decreasing

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, doc string, n_words string, ids string, place string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{k % 97}x{k % 89}" for k in range(6000))
SHARED = " ".join(f"shared{k}" for k in range(40))
TEXTS = [
    None, "", " \t\n", "one", "one", "One", "two words", "Two  Words", LONG, LONG + " tail", LONG,
    f"alpha start here {SHARED} and an end", f"{SHARED} beta", f"gamma {SHARED} {SHARED} delta",
    "a b c d e f g h " * 12, "line with # sign\nline with # sign\n\nother | line", "Grüße aus Köln und Zürich – naïve café 日本語 🙂",
    "a b c d", "x" * 5000, "1234 5678 !!", "a b c d", "a b c d",
]


def rows_of(texts):
    return [(k + 1, t, "s", "en" if k % 2 else "de", len(t or ""), "clash", "clash", "clash", None) for k, t in enumerate(texts)]


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return SPLIT.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 200").select("doc_id", "text").orderBy("doc_id").collect()
    return {k + 1: t for k, t in enumerate(TEXTS + [r.text for r in small])}


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows_of(docs.values()), SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_bpe_round_trip_equals_tiktoken(spark, docs, folder):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op1_bpe(spark, folder).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        ids = plain.encode_ordinary(text or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text or ""))


def test_exact_dedup(spark, docs, folder):
    groups = {}
    for k, text in docs.items():
        groups.setdefault(text or "", []).append(k)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op2_exact_dedup(spark, folder).collect()}
    assert got == {k: (max(groups[t or ""]), len(groups[t or ""]), k == max(groups[t or ""]), sha(t or "")) for k, t in docs.items()}


def test_jaccard_components(spark, docs, folder):
    sets = {}
    for k, text in docs.items():
        w = words(lower(text or ""))
        sets[k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, folder).collect()}
    assert got == {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("changed, places, most_rows, most_pairs", [(2, 40, 3000, 4000), (3, 150, 200, 800)])
def test_jaccard_large_group_near_the_threshold(spark, monkeypatch, changed, places, most_rows, most_pairs):
    """Near copies without their original, of which few link: neither their pairs are compared nor tokens that can't be a first common one held."""
    chance, texts = random.Random(7), {}
    for k in range(1, 151):
        own = {place: f"own{k}x{place}" for place in chance.sample(range(places), changed)}
        texts[k] = " ".join(own.get(place, f"word{place}") for place in range(150))
    held, compared, across, links = [], [], jaccard_join._across, jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_across", lambda mixed, *more: held.append(mixed.count()) or across(mixed, *more))
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *more: compared.append(pairs.count()) or links(pairs, *more))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs, 4, 85, 100).collect()}
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(147)} for k, t in texts.items()}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = sorted((root[a], root[b]))[::-1]
                root = {k: new if r == old else r for k, r in root.items()}
    assert got == root
    assert sum(held) <= most_rows and sum(compared) <= most_pairs


def test_jaccard_repeated_rows_count_once(spark):
    """Rows that repeat an identifier add nothing to an overlap, and its texts are compared one by one."""
    text = lambda *changed: " ".join(f"own{k}" if k in changed else f"word{k}" for k in range(60))
    rows = [(1, text()), (2, text(20, 40)), (2, text(20, 40)), (3, text(30)), (4, text(10, 50)), (4, " ".join(f"other{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(docs, 4, 85, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_hmm_counts_and_base(spark, docs, folder):
    tokens = {k: [*words(lower(t or "")), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in docs}
    counts = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in queries.op5_hmm_score(spark, folder).collect():
        t = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_forward_recursion_sums_all_paths():
    model = initial(np.array([0.5, 0.3, 0.2]), states=3)
    seq = np.array([0, 2, 1, 1])
    total = 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += p
    assert math.isclose(log_likelihood(model, [seq])[0], math.log(total), rel_tol=1e-9)


def test_quality_measures(spark, docs, folder):
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, folder).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = Counter(windows)
        hit = {j for i, g in enumerate(windows) if seen[g] > 1 for j in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, k
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_language(spark, docs, folder):
    for r in queries.op7_language_id(spark, folder).collect():
        text = docs[r.doc_id] or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang IS NOT NULL").collect()}
    rows = [r for r in queries.op7_language_id(spark, SMALL).where("held_out AND lang_pred <> 'und'").collect() if r.doc_id in lang]
    assert rows and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_substring_dedup(spark, docs, folder):
    first = {}
    for k in sorted(docs):
        w = words(docs[k])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, folder).collect()}
    want = {}
    for k, text in docs.items():
        w = words(text)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(i, i + 13)}
        want[k] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == want


def test_packing(spark, docs, folder):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in docs.items()}
    pieces = queries.op9_packing(spark, folder).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == docs.keys()
    for k, held in by_doc.items():
        at = 0
        for p in sorted(held, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[k])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[k])
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_sequence) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_best_fit_takes_the_tightest_window():
    lengths = sorted(np.random.default_rng(3).integers(1, 101, 400).tolist(), reverse=True)
    window, offset = best_fit_decreasing(lengths, 100)
    room, want = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(100 - n)
        want.append(sorted(room))
    used = Counter()
    for w, o, n in zip(window, offset, lengths):
        assert o == used[w]
        used[w] += n
    assert sorted(100 - u for u in used.values()) == sorted(room)


PAGES = [
    (1, None, None), (2, "", ""), (3, "no scheme", "<p>plain words of a page</p>"), (4, "http://A.Example.NET/en/x?q#f", "<b>"),
    (5, "https://example.net/fr/", "<html"), (6, "http://w.example.com/de/a", ""), (7, "http://x.org/fr/a", ""), (8, "http://x.org/frx", ""),
    (9, "http://net/", ""), (10, "http://notnet", ""), (11, "ftp://h?x/en/", ""), (11, "ftp://h?x/en/", ""),
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'c' AS host", "'c' AS path", "'c' AS text").write.parquet(f"{root}/pages.parquet")
    return root


def test_url_rules(spark, pages):
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op3_url_filter(spark, pages).collect() if r.page_id < 9 and r.rule)
    assert got == [
        (4, "a.example.net", "/en/x", "example.net/en/", "allow"), (5, "example.net", "/fr/", "net/", "block"),
        (6, "w.example.com", "/de/a", "example.com/de/", "block"), (7, "x.org", "/fr/a", "org/fr/", "allow"),
    ]
    rest = {r.page_id: (r.host, r.path, r.rule) for r in queries.op3_url_filter(spark, pages).collect()}
    assert rest[1] == rest[2] == rest[3] == ("", "", None) and rest[9] == ("net", "/", "net/") and rest[11] == ("h", "", None)
    assert len(PAGES) == queries.op3_url_filter(spark, pages).where("verdict IN ('allow', 'block')").count()


def test_html_extract(spark, pages):
    got = [(r.page_id, r.text, r.n_chars) for r in queries.op10_html_extract(spark, pages).collect()]
    assert len(got) == len(PAGES) and all(n == len(t) for _, t, n in got)
    assert {k: t for k, t, _ in got}[1] == {k: t for k, t, _ in got}[2] == ""
    page = "<html><body><nav>Menu Home</nav><article><h1>Title &amp; more</h1><p>First\n  block of <b>running</b> text.</p><p>Second one.</p></article><footer>Imprint</footer><script>x()</script></body></html>"
    assert html_extract.extract(page, None) == "Title & more\nFirst block of running text.\nSecond one."


def test_empty_tables(spark, empty):
    for name, query in queries.registry().items():
        assert query(spark, empty).count() == 0, name
