"""Packing of token sequences into windows by best-fit decreasing.

Every document becomes its token ids and one end id. Documents of a window or more are first cut
into full windows; what remains is packed, longest first, into the open window with the least
room that still takes it. A segment tree over the remaining capacities finds that window in
log2(capacity) steps.

Only lengths take part in packing, so ids never travel: a task tokenises a document, cuts it and
keeps each piece's length and checksum. Pieces are dealt at random into groups of about
``group_pieces``, each packed by one task; a group leaves at most a few windows with room, so
groups cost next to no padding and no task grows with the table.

Defined results: a NULL or empty text is one piece with only the end id. Repeated rows are
packed as often as they come. A NULL ``doc_id`` is carried. An empty table has no pieces.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stagecast.llm.common import grouped_rows, materialise, ready, tidy
from stagecast.llm.shingles import forget

#: Chunks between these characters are tokenised independently; other white space stays inside.
_CHUNK = re.compile(r"[^ \t\n\r]+")
#: White space for Python, though not for the tokenizer.
_CONTROL = re.compile(r"[\x1c-\x1f]")
#: Chunks, and parts of chunks, that a worker remembers before it starts anew.
_REMEMBERED = 400_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Letters that are their own normal form, between signs that are one token run for the tokenizer.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Words that are tokenised as one text.
_TOGETHER = 1000


def _raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """Ids of white-space separated chunks, as little-endian uint32; remembers what it has met.

    The tokenizer drops white space and never looks across it, so equal chunks have equal ids. It
    also lowers case and splits letters from signs, so a plain chunk is composed of its parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._chunks: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {"": b""}

    def _each(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return ((text, _raw(e.ids)) for text, e in zip(texts, encoded))

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words of letters: tokenised together and cut at the tokens that end a word."""
        for at in range(0, len(words), _TOGETHER):
            part = words[at : at + _TOGETHER]
            ids = np.array(self._tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            yield from ((word, raw[a:b]) for word, a, b in zip(part, [0, *ends], ends))

    def _learn(self, new: set[str]) -> None:
        plain, other = {}, []
        for chunk in new:
            found = None if "<|" in chunk else _PLAIN.fullmatch(chunk)  # may be a special token
            if found:
                plain[chunk] = found[1], found[2].lower(), found[3]
            else:
                other.append(chunk)
        if len(self._parts) > _REMEMBERED:
            self._parts = {"": b""}
        self._parts.update(self._words([*{p[1] for p in plain.values()}.difference(self._parts)]))
        self._parts.update(self._each([*{s for p in plain.values() for s in (p[0], p[2])}.difference(self._parts)]))
        parts = self._parts
        self._chunks.update((chunk, parts[a] + parts[b] + parts[c]) for chunk, (a, b, c) in plain.items())
        self._chunks.update(self._each(other))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as the tokenizer gives them for the whole text."""
        chunks = [chunks_of(text) for text in texts]
        new = set(chain.from_iterable(chunks)).difference(self._chunks)
        if new and len(self._chunks) + len(new) > _REMEMBERED:
            self._chunks.clear()
            new = set(chain.from_iterable(chunks))
        self._learn(new)
        return [b"".join(map(self._chunks.__getitem__, c)) for c in chunks]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def chunks_of(text: str) -> list[str]:
    """Runs of anything but white space, as the tokenizer sees it."""
    return _CHUNK.findall(text) if _CONTROL.search(text) else text.split()


def cut(raw: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the full windows and of what remains."""
    for start in range(0, len(raw), 4 * window):
        piece = raw[start : start + 4 * window]
        yield start // 4, len(piece) // 4, zlib.crc32(piece)


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that counts them."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._leaves)
        self._windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, capacity: int, window: int) -> None:
        self._windows[capacity].append(window)
        self._change(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest window for ``length``."""
        node, count = length + self._leaves, self._count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self._leaves
        self._change(capacity, -1)
        return capacity, self._windows[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self._leaves
        while node:
            self._count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; ``lengths`` descend."""
    opened, windows, offsets, n = OpenWindows(capacity), [], [], 0
    for length in lengths:
        room, window = opened.take(length) or (capacity, None)
        if window is None:
            window, n = n, n + 1
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            opened.add(room - length, window)
    return windows, offsets


def pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of a document, cut at full windows."""
    ready(docs.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, end = 0, array("I", [end_id]).tobytes()
        for ids, texts in grouped_rows(batches, [id_col, text_col]):
            rows = []
            for doc, tokens in zip(ids, encoder(tokenizer_path).encode([t or "" for t in texts])):
                tokens += end
                for start, length, crc in cut(tokens, window):
                    rows.append((doc, start, length, crc, len(tokens) // 4, salt))
                    salt += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            )
        forget()  # what an earlier stage has left in this worker
        tidy()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tokenise, _PIECES)


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, group_pieces: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and its place there."""
    cut_up = materialise(pieces(docs, tokenizer_path, window, end_id, id_col, text_col), "pieces")
    groups = max(1, math.ceil(cut_up.count() / group_pieces))
    dealt = cut_up.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(groups)))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "salt"], ascending=[False, True, True, True])
        windows, offsets = best_fit_decreasing(rows["length"].tolist(), window)
        rows["sequence_id"] = np.array(windows, dtype=np.int64) * groups + int(key[0])
        rows["offset"] = offsets
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("group").applyInPandas(fit, _PACKED)
