"""Alignment of two tokenizers over a corpus, counted with inverted pair bitmaps.

A byte-level BPE (A) and a sentence-piece model (B) cut the same bytes, ``" " + text``. Two tokens
are linked where their byte ranges overlap; the places where both end cut them into groups. How
often a pair of ids is linked in the whole corpus is counted from an inverted index: for every pair
the set of documents as a compressed bitmap, and one bitmap per binary digit of the number of
links in a document (multiplicity planes). Popcounts of the planes give the links, those of their
union the documents; the counts then return through the postings to the documents.

* A task cuts its texts at white space where neither tokenizer can reach across, so that it aligns
  every distinct chunk once. Batches of documents become segments, which are OR-merged into a
  container: bitmaps of at most ``CONTAINER_DOCS`` documents, as their non-zero 64-bit words.
* Containers hold different documents, so their popcounts add up. Only (pair, counts) is shuffled.
* A container asks for the counts of its own pairs and adds them up per document. No pair, however
  frequent, has more than one row per container, and no task holds more than one container.

Defined results: a text that is NULL, empty, or not reproduced byte by byte by both tokenizers has
no tokens: zeros, and ``groups_sha256`` is the empty string. Rows are kept as they come, with
repeated or NULL identifiers; other columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stagecast.llm.common import materialise, ready

#: Documents of one container, and links after which it is closed.
CONTAINER_DOCS, CONTAINER_LINKS = 8192, 4_000_000
#: Characters of distinct chunks that a worker remembers before it starts anew.
REMEMBERED_CHARS = 12_000_000

_SPACE = "▁"
#: White space other than blank and newline, in any library's sense: such texts are cut with care.
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​﻿]")
_PLAIN_CHUNK = re.compile(r"[ \n]+[^ \n]+|[ \n]+")
_CAREFUL_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​﻿])(?=[ \n])")

_STATS = ("n_a", "n_b", "n_groups", "n_links")
_CONTAINER = (
    "container long, docs array<long>, known array<boolean>, "
    + ", ".join(f"{c} array<long>" for c in _STATS)
    + ", groups_sha256 array<string>, bitmaps binary"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def chunks_of(text: str) -> list[str]:
    """``" " + text`` cut before blanks and newlines that follow anything but white space.

    A's pattern starts a new match there, and none of B's pieces has a blank or newline after
    another character (checked when B is loaded).
    """
    text = " " + text
    return _CAREFUL_CUT.split(text) if _ODD.search(text) else _PLAIN_CHUNK.findall(text)


def align(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> tuple[str, int, list[tuple[int, int]]]:
    """Groups as text, their number, and the linked id pairs of two cuts of the same bytes."""
    i = j = a_from = b_from = 0
    groups, links = [], []
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        ends = a_ends[i], b_ends[j]
        i += ends[0] <= ends[1]
        j += ends[1] <= ends[0]
        if ends[0] == ends[1]:
            groups.append(",".join(map(str, a[a_from:i])) + "|" + ",".join(map(str, b[b_from:j])))
            a_from, b_from = i, j
    return ";".join(groups), len(groups), links


class Tokenizers:
    """Both tokenizers with the bytes of their ids, and everything learnt about chunks so far."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self._a.get_vocab()
        self._a_bytes = [b""] * (max(vocabulary.values()) + 1)
        alphabet = byte_alphabet()
        for token, i in vocabulary.items():
            self._a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self._b_bytes, self.b_size = [], self._b.get_piece_size()
        for i in range(self.b_size):
            piece = self._b.id_to_piece(i)
            if self._b.is_byte(i):
                self._b_bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            if "\n" in piece or " " in piece or _SPACE in piece.lstrip(_SPACE):
                raise ValueError(f"piece {i} reaches across white space: {piece!r}")
            self._b_bytes.append(piece.replace(_SPACE, " ").encode())
        self._lead = self._b.encode("\n")
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = {}
        self._chars = 0
        self._groups: list[str] = []
        self._wrong: set[int] = set()
        self._stats = array("q")       # n_a, n_b, n_groups, n_links per chunk
        self._starts = array("q", [0])  # where a chunk's links begin
        self._links = array("q")       # a * b_size + b

    def _learn(self, chunks: list[str]) -> None:
        lead = len(self._lead)
        encoded = self._a.encode_batch(chunks, add_special_tokens=False)
        # A newline in front keeps B from adding its own blank to the chunk.
        pieces = self._b.encode(["\n" + c for c in chunks], num_threads=1)
        for chunk, found, b in zip(chunks, encoded, pieces):
            a, number = found.ids, len(self._groups)
            if b[:lead] != self._lead:
                raise ValueError("the piece model doesn't keep a leading newline apart")
            b = b[lead:]
            a_parts, b_parts = [self._a_bytes[x] for x in a], [self._b_bytes[x] for x in b]
            raw = chunk.encode()
            if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
                self._wrong.add(number)
                groups, n, links = "", 0, []
            else:
                groups, n, links = align(a, b, list(accumulate(map(len, a_parts))), list(accumulate(map(len, b_parts))))
            self._numbers[chunk] = number
            self._chars += len(chunk)
            self._groups.append(groups)
            self._stats.extend((len(a), len(b), n, len(links)))
            self._links.extend(x * self.b_size + y for x, y in links)
            self._starts.append(len(self._links))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Statistics (one row per text), digests of the groups, and all links: (text, pair)."""
        cut = [chunks_of(t) if t else [] for t in texts]
        if self._chars > REMEMBERED_CHARS:
            self._forget()
        new = set().union(*cut).difference(self._numbers)
        if new:
            self._learn(list(new))
        numbers = [[*map(self._numbers.__getitem__, chunks)] for chunks in cut]
        if self._wrong:
            numbers = [[] if not self._wrong.isdisjoint(n) else n for n in numbers]
        digests = [hashlib.sha256(";".join(map(self._groups.__getitem__, n)).encode()).hexdigest() if n else "" for n in numbers]
        lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter((x for n in numbers for x in n), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        stats = np.zeros((len(texts), 4), np.int64)
        per_chunk = np.frombuffer(self._stats, np.int64).reshape(-1, 4)
        running = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(per_chunk[flat], axis=0)]) if len(flat) else np.zeros((1, 4), np.int64)
        ends = np.cumsum(lengths)
        stats[:] = running[ends] - running[ends - lengths]
        starts = np.frombuffer(self._starts, np.int64)
        first, count = starts[flat], starts[flat + 1] - starts[flat]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        links = np.frombuffer(self._links, np.int64) if len(self._links) else np.zeros(0, np.int64)
        return stats, digests, np.repeat(owner, count), links[at]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others follow from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return shown | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Bitmaps:
    """Documents and multiplicity planes of pairs over the slots of one container.

    ``planes[k]`` holds the non-zero words of digit k as (pair, word number, 64 bits), sorted by
    pair and word number.
    """

    def __init__(self, planes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.planes = planes

    @classmethod
    def of_links(cls, slots: np.ndarray, pairs: np.ndarray) -> "Bitmaps":
        at = np.sort(pairs * CONTAINER_DOCS + slots)
        heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        times, at = np.diff(np.r_[heads, len(at)]), at[heads]
        planes = []
        while len(times) and times.any():
            planes.append(_words(at[times & 1 == 1]))
            times >>= 1
        return cls(planes)

    def merged(self, other: "Bitmaps") -> "Bitmaps":
        """Union by OR of the words; the two have no document in common."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.uint64))
        planes = []
        for k in range(max(len(self.planes), len(other.planes))):
            parts = [x.planes[k] if k < len(x.planes) else none for x in (self, other)]
            planes.append(_or_words(*[np.concatenate(c) for c in zip(*parts)]))
        return Bitmaps(planes)

    def pairs(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, _, _ in self.planes)]))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, their documents (popcount of the union) and links (weighted popcounts)."""
        pairs = self.pairs()
        links = np.zeros(len(pairs), np.int64)
        for k, (pair, _, bits) in enumerate(self.planes):
            np.add.at(links, np.searchsorted(pairs, pair), np.bitwise_count(bits).astype(np.int64) << k)
        docs = np.zeros(len(pairs), np.int64)
        if self.planes:
            pair, _, bits = _or_words(*[np.concatenate(c) for c in zip(*self.planes)])
            np.add.at(docs, np.searchsorted(pairs, pair), np.bitwise_count(bits).astype(np.int64))
        return pairs, docs, links

    def summed(self, pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per slot the sum of links times the weight of their pair; ``pairs`` ascend, weights are whole."""
        total = np.zeros(CONTAINER_DOCS, np.int64)
        for k, (pair, word, bits) in enumerate(self.planes):
            weight, first = weights[np.searchsorted(pairs, pair)] << k, word.astype(np.int64) << 6
            while len(bits):  # the lowest bit of every word, until none is left
                low = bits & (~bits + np.uint64(1))
                np.add.at(total, first + np.log2(low.astype(np.float64)).astype(np.int64), weight)
                bits = bits ^ low
                left = bits != 0
                bits, weight, first = bits[left], weight[left], first[left]
        return total

    def packed(self) -> bytes:
        out = [np.int64(len(self.planes)).tobytes()]
        for pair, word, bits in self.planes:
            out += [np.int64(len(pair)).tobytes(), np.diff(pair, prepend=0).tobytes(), word.tobytes(), bits.tobytes()]
        raw = b"".join(out)
        return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, raw: bytes) -> "Bitmaps":
        size = int(np.frombuffer(raw, np.int64, 1)[0])
        raw, at, planes = pa.decompress(raw[8:], size, codec="zstd", asbytes=True), 8, []
        for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
            n, at, part = int(np.frombuffer(raw, np.int64, 1, at)[0]), at + 8, []
            for kind in (np.int64, np.int16, np.uint64):
                part.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            planes.append((np.cumsum(part[0]), part[1], part[2]))
        return cls(planes)


def _words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending pair * CONTAINER_DOCS + slot as words."""
    pair, slot = at // CONTAINER_DOCS, at % CONTAINER_DOCS
    return _or_words(pair, (slot >> 6).astype(np.int16), np.uint64(1) << (slot & 63).astype(np.uint64))


def _or_words(pair: np.ndarray, word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the same pair and number become one by OR; the result is sorted."""
    key = pair * (CONTAINER_DOCS // 64) + word
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, pair, word, bits = key[order], pair[order], word[order], bits[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return pair[heads], word[heads], np.bitwise_or.reduceat(bits, heads) if len(heads) else bits


class _Open:
    """The container that a task is filling."""

    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.stats, self.digests, self.links = [], [], 0
        self.segments: list[Bitmaps] = []

    def row(self, number: int) -> pa.RecordBatch:
        # Segments of similar size are merged in pairs.
        while len(self.segments) > 1:
            self.segments = [
                self.segments[k].merged(self.segments[k + 1]) if k + 1 < len(self.segments) else self.segments[k]
                for k in range(0, len(self.segments), 2)
            ]
        stats = np.concatenate(self.stats)
        known = [d is not None for d in self.docs]
        lists = [pa.array([[d or 0 for d in self.docs]], pa.list_(pa.int64())), pa.array([known], pa.list_(pa.bool_()))]
        lists += [pa.array([stats[:, k].tolist()], pa.list_(pa.int64())) for k in range(4)]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *lists, pa.array([self.digests], pa.list_(pa.string())),
             pa.array([self.segments[0].packed()], pa.binary())],
            ["container", "docs", "known", *_STATS, "groups_sha256", "bitmaps"],
        )


def containers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index as a written table: one row per container of documents."""
    ready(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held = tokenizers(a_path, b_path), _Open()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and end - at < 1000 and (end == at or chars < 4_000_000):
                    chars += len(texts[end] or "")
                    end += 1
                if len(held.docs) + end - at > CONTAINER_DOCS or held.links > CONTAINER_LINKS:
                    yield held.row(number)
                    held, number = _Open(), number + 1
                stats, digests, owner, pairs = both.documents([t or "" for t in texts[at:end]])
                held.segments.append(Bitmaps.of_links(owner + len(held.docs), pairs))
                held.docs += ids[at:end]
                held.stats.append(stats)
                held.digests += digests
                held.links += len(pairs)
                at = end
        if held.docs:
            yield held.row(number)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return materialise(rows.mapInArrow(index, _CONTAINER), "pair-index")


def _contents(index: DataFrame) -> DataFrame:
    """(container, pair, docs, links) of every container."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs, docs, links = Bitmaps.unpacked(raw.as_py()).counts()
                for a in range(0, len(pairs), 100_000):
                    part = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs[part]), number)), *(pa.array(x[part]) for x in (pairs, docs, links))],
                        ["container", "pair", "docs", "links"],
                    )

    return index.select("container", "bitmaps").mapInArrow(read, "container long, pair long, docs long, links long")


def pair_counts(index: DataFrame, b_size: int) -> DataFrame:
    """pair, b_id, docs, links, best: the counts of the whole corpus.

    ``best`` says that no other id of A is linked with this id of B more often. A group of one id of
    B has at most as many rows as A has ids.
    """
    total = _contents(index).groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    total = total.withColumn("b_id", F.col("pair") % F.lit(b_size))
    return total.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b_id")))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its tokens, groups and links, and how frequent its links are in the corpus."""
    index = containers(docs, a_path, b_path, id_col, text_col)
    b_size = tokenizers(a_path, b_path).b_size
    counted = pair_counts(index, b_size).select("pair", "links", "best")
    wanted = _contents(index).select("container", "pair").join(counted, "pair")

    def give(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, right = left.iloc[0], right.sort_values("pair")
        n, bitmaps, pairs = len(row["docs"]), Bitmaps.unpacked(row["bitmaps"]), right["pair"].to_numpy()
        links, best = right["links"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        return pd.DataFrame({
            "doc_id": pd.array([d if k else None for d, k in zip(row["docs"], row["known"])], dtype="Int64"),
            **{c: np.asarray(row[c], dtype=np.int64) for c in _STATS},
            "n_best": bitmaps.summed(pairs, best)[:n],
            "count_sum": bitmaps.summed(pairs, links)[:n],
            "groups_sha256": list(row["groups_sha256"]),
        })

    return index.groupBy("container").cogroup(wanted.groupBy("container")).applyInPandas(give, _RESULT)
