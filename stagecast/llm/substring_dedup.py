"""Substring deduplication with an FM-index per shard.

A window is a run of ``window`` words. A window that also starts in a document with a smaller
identifier is repeated, and its words go.

1. Rows are gathered in blocks, each one compressed value, and stored. All later steps work on whole
   blocks: words are numbered by a block's own vocabulary, and arrays run over all its texts at once.
2. Every window has an anchor, the smallest hash of the short runs of words inside it. Equal windows
   have equal anchors. Anchors are counted exactly, by ranges of their hash, and each block gets back one
   bit per anchor: only windows whose anchor several documents have can be repeated.
3. Neighbouring windows with one anchor form a segment. Segments go to shards by anchor, so equal
   windows meet. Windows of an anchor of very many documents go one by one, by their own hash. A
   segment is sent once for each block of documents that hold it, with their smallest identifier.
4. A shard builds a compressed FM-index of its segments and streams them through it: backward
   search over the wavelet tree gives matching statistics, and for each match of a whole window the
   smallest document of its suffix interval.
5. Answers go back to their blocks, which put the texts together without their repeated windows.

Shards and ranges grow with the texts; nothing that does comes to the driver or is broadcast.

Defined results: NULL and empty texts have no words. Documents of equal identifier don't repeat each
other. Documents with a NULL identifier keep all words and count for no other. Texts are processed
whole. Extra columns are kept; the columns of the result replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from stagecast.llm.common import materialise, ready
from stagecast.llm.fm_index import FMIndex
from stagecast.llm.shingles import run_hashes

#: Words of the runs among which anchors are chosen.
GRAM = 5
#: Bits of an anchor's hash that are counted; anchors that agree in them pass together.
ANCHOR_BITS = 48
#: Documents of an anchor from which its windows are sent one by one.
HOT = 1000
#: Bytes of all texts for each shard. Segments repeat words, so a shard gets about a million words.
SHARD_BYTES = 3_000_000
#: Bytes of all texts for each range of anchors: about a million anchors.
RANGE_BYTES = 32_000_000
#: Bytes of the texts of one block, but for a longer single text: what a task holds at a time.
BLOCK_BYTES = 12_000_000


def _squeeze(*parts: bytes) -> bytes:
    """Parts as one compressed value; ``_spread`` takes them apart."""
    sizes = np.array([len(parts), *map(len, parts)], "<i8")
    return zstandard.compress(sizes.tobytes() + b"".join(parts))


def _spread(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(raw, "<i8", n, 8))
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends.tolist()], ends.tolist())]


def _filled(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


# --- blocks -------------------------------------------------------------------------------------


def _blocks(rows: DataFrame) -> DataFrame:
    """block, size (bytes of its texts), data (its rows as a compressed Arrow stream)."""

    def packed(number: int, size: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in held:
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["block", "size", "data"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES - size, "right")))
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1]) - before
                if last < batch.num_rows or size >= BLOCK_BYTES:
                    yield packed(number, size, held)
                    number, size, held = number + 1, 0, []
                first = last
        if held:
            yield packed(number, size, held)

    return rows.mapInArrow(gather, "block long, size long, data binary")


@dataclass
class _Block:
    """Rows of a block and the words of all its texts as numbers of its vocabulary."""

    rows: pa.Table
    vocabulary: pa.Array
    codes: np.ndarray
    ends: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> _Block:
        rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        # Splits at the six ASCII white-space characters; what stands between two of them is empty.
        lists = pc.ascii_split_whitespace(pc.fill_null(rows.column("text"), "")).combine_chunks()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        real = codes != pc.index(coded.dictionary, "").as_py()
        offsets = lists.offsets.to_numpy()
        return cls(rows, coded.dictionary, codes[real], np.r_[0, np.cumsum(real)][offsets[1:] - offsets[0]])

    @property
    def docs(self) -> np.ndarray:
        """Identifiers, 0 for NULL."""
        return pc.fill_null(self.rows.column("doc"), 0).to_numpy()

    def row_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, words, "right")


@dataclass
class _Windows:
    """Windows of a block: where they start, in runs of one anchor, and the counted part of the anchors' hashes."""

    hashes: np.ndarray  # of every word
    starts: np.ndarray  # of every window
    runs: np.ndarray  # number of the first window of each run
    anchors: np.ndarray  # hash of each run's anchor
    known: np.ndarray  # sorted distinct counted hashes
    number: np.ndarray  # which of them a run has
    counts: np.ndarray  # texts of the block with each

    @classmethod
    def of(cls, block: _Block, window: int) -> _Windows:
        table = np.fromiter(map(xxh3_64_intdigest, block.vocabulary.to_pylist()), np.uint64, len(block.vocabulary))
        hashes = table[block.codes]
        n = max(0, len(hashes) - window + 1)
        gram = min(GRAM, window)
        grams = run_hashes(hashes, gram)
        best, at = grams[:n].copy(), np.zeros(n, np.min_scalar_type(window))
        for k in range(1, window - gram + 1):
            other = grams[k : k + n]
            less = other < best
            np.copyto(best, other, where=less)
            np.copyto(at, at.dtype.type(k), where=less)
        lengths = np.diff(block.ends, prepend=0)
        counted = pc.is_valid(block.rows.column("doc")).to_numpy()
        starts = _filled(block.ends - lengths, np.where(counted, np.maximum(lengths - window + 1, 0), 0))
        at = starts + at[starts]
        runs = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        anchors = best[starts[runs]]
        known, number = np.unique(anchors >> np.uint64(64 - ANCHOR_BITS), return_inverse=True)
        rows = block.row_of(starts[runs])
        pairs = np.unique(number * np.int64(len(block.ends) + 1) + rows)
        counts = np.bincount(pairs // (len(block.ends) + 1), minlength=len(known))
        return cls(hashes, starts, runs, anchors, known, number, counts)

    def ranges(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of hashes that occur, and where they begin and end in ``known``."""
        place = ((self.known >> np.uint64(ANCHOR_BITS - 32)) * np.uint64(n)) >> np.uint64(32)
        present, first = np.unique(place.astype(np.int64), return_index=True)
        return present, np.r_[first, len(self.known)]


# --- anchors ------------------------------------------------------------------------------------


def _live(blocks: DataFrame, window: int, ranges: int) -> DataFrame:
    """block, range, bits: of the block's anchors in a range, those of several and those of very many documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                held = _Windows.of(_Block.read(data), window)
                present, cuts = held.ranges(ranges)
                counts = np.minimum(held.counts, HOT).astype("<u2")
                sent = [
                    # Bytes of equal weight side by side: those of high weight are nearly all zero.
                    _squeeze(np.diff(held.known[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), counts[a:b].tobytes())
                    for a, b in zip(cuts, cuts[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present, pa.int64()), pa.array([number] * len(sent), pa.int64()), pa.array(sent, pa.binary())],
                    ["range", "block", "data"],
                )

    def add(sent: pa.Table) -> pa.Table:
        hashes, counts = [], []
        for data in sent.column("data").to_pylist():
            gaps, n = _spread(data)
            gaps = np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(8, -1).T).view("<u8").ravel()
            hashes.append(np.cumsum(gaps, dtype=np.uint64))
            counts.append(np.frombuffer(n, "<u2"))
        _, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(number, np.concatenate(counts))[number]
        bits = [
            _squeeze(np.packbits(part >= 2).tobytes(), np.packbits(part >= HOT).tobytes()) if part.max() >= 2 else None
            for part in np.split(total, np.cumsum([len(h) for h in hashes])[:-1])
        ]
        return pa.table({"block": sent.column("block"), "range": sent.column("range"), "bits": pa.array(bits, pa.binary())})

    messages = blocks.mapInArrow(count, "range long, block long, data binary")
    return messages.groupBy("range").applyInArrow(add, "block long, range long, bits binary").where("bits IS NOT NULL")


# --- segments -----------------------------------------------------------------------------------

_PLACED = pa.schema([("place", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])


def _segments(blocks: DataFrame, live: DataFrame, window: int, ranges: int, shards: int) -> DataFrame:
    """place, block, data: segments of a block by shard, and (place below 0) where they stand in the block."""

    def cut(block: pa.Table, live: pa.Table) -> pa.Table:
        if not live.num_rows or not block.num_rows:
            return _PLACED.empty_table()
        number, held = block.column("block")[0].as_py(), _Block.read(block.column("data")[0].as_py())
        found = _Windows.of(held, window)
        several, many = np.zeros(len(found.known), bool), np.zeros(len(found.known), bool)
        present, cuts = found.ranges(ranges)
        slices = {r: (a, b) for r, a, b in zip(present.tolist(), cuts.tolist(), cuts[1:].tolist())}
        for r, bits in zip(live.column("range").to_pylist(), live.column("bits").to_pylist()):
            a, b = slices[r]
            several[a:b], many[a:b] = (np.unpackbits(np.frombuffer(p, np.uint8), count=b - a) for p in _spread(bits))
        sizes = np.diff(np.r_[found.runs, len(found.starts)])
        passing, single = several[found.number], many[found.number]
        # First window and number of windows of each segment: a run, or one window of it.
        plain, one = passing & ~single, np.flatnonzero(passing & single)
        lone = _filled(found.runs[one], sizes[one])
        first = found.starts[np.r_[found.runs[plain], lone]]
        length = np.r_[sizes[plain], np.ones(len(lone), np.int64)] + window - 1
        alone = run_hashes(found.hashes, window)[found.starts[lone]] if len(lone) else np.empty(0, np.uint64)
        place = np.r_[found.anchors[plain], alone]
        text = memoryview(held.codes.astype("<i4", copy=False)).cast("B")
        known: dict[bytes, int] = {}
        cuts = zip(map(int, 4 * first), map(int, 4 * (first + length)))
        seg = np.fromiter((known.setdefault(bytes(text[a:b]), len(known)) for a, b in cuts), "<i4", len(first))
        del known
        docs = held.docs[held.row_of(first)]
        _, shown = np.unique(seg, return_index=True)
        least, most = docs[shown].copy(), docs[shown].copy()
        np.minimum.at(least, seg, docs)
        np.maximum.at(most, seg, docs)
        shard = (place[shown] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        places, starts = np.unique(shard[order], return_index=True)
        data = [_squeeze(first.astype("<i4").tobytes(), seg.tobytes())]
        for part in np.split(order, starts[1:]):
            lengths = length[shown[part]]
            own, codes = np.unique(held.codes[_filled(first[shown[part]], lengths)], return_inverse=True)
            data.append(_squeeze(
                part.astype("<i4").tobytes(), least[part].tobytes(), (most - least)[part].tobytes(), lengths.astype("<i4").tobytes(),
                codes.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes(), "\n".join(held.vocabulary.take(pa.array(own)).to_pylist()).encode(),
            ))
        return pa.table([pa.array([-1 - number, *places.tolist()], pa.int64()), pa.array([number] * len(data), pa.int64()), pa.array(data, pa.binary())], schema=_PLACED)

    return blocks.groupBy("block").cogroup(live.groupBy("block")).applyInArrow(cut, "place long, block long, data binary")


def _search(placed: pa.Table, window: int) -> list[tuple[int, bytes]]:
    """By block: segments of a shard with a repeated window, and the smallest document of each of their windows."""
    numbers: dict[str, int] = {}
    known: dict[bytes, int] = {}
    values, blocks = [], []
    for packed in placed.column("data").to_pylist():
        seg, least, over, lengths, codes, words = _spread(packed)
        seg, least, over, lengths = (np.frombuffer(p, kind) for p, kind in ((seg, "<i4"), (least, "<i8"), (over, "<i8"), (lengths, "<i4")))
        own = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words.decode().split("\n")], "<i4")
        text = own[np.frombuffer(codes, "<u2" if len(own) <= 1 << 16 else "<u4")].tobytes()
        ends = 4 * np.cumsum(lengths, dtype=np.int64)
        code = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip((ends - 4 * lengths).tolist(), ends.tolist())])
        values.append((code, least))
        blocks.append((seg, least + over, code))
    smallest_of = np.full(len(known), np.iinfo(np.int64).max)
    for code, least in values:
        np.minimum.at(smallest_of, code, least)
    coded = [np.frombuffer(k, "<i4") for k in known]
    found = FMIndex(coded, smallest_of, window, len(numbers) + 1).statistics(coded)
    lengths = np.array([len(f) for f in found])
    flat, starts = np.concatenate(found), np.cumsum(lengths) - lengths
    smallest = np.minimum.reduceat(flat, starts)
    out = []
    for block, (seg, most, code) in zip(placed.column("block").to_pylist(), blocks):
        told = np.flatnonzero(smallest[code] < most)
        if len(told):
            windows = flat[_filled(starts[code[told]], lengths[code[told]])]
            out.append((block, _squeeze(seg[told].tobytes(), lengths[code[told]].astype("<i4").tobytes(), windows.astype("<i8").tobytes())))
    return out


def _answers(segments: DataFrame, window: int) -> DataFrame:
    """block, data: answers of the shards (``told``), and where segments stand in the block, as they came."""

    def search(placed: pa.Table) -> pa.Table:
        stand = placed.column("place")[0].as_py() < 0
        rows = list(zip(placed.column("block").to_pylist(), placed.column("data").to_pylist())) if stand else _search(placed, window)
        return pa.table({
            "block": pa.array([r[0] for r in rows], pa.int64()), "told": pa.array([not stand] * len(rows), pa.bool_()), "data": pa.array([r[1] for r in rows], pa.binary()),
        })

    return segments.groupBy("place").applyInArrow(search, "block long, told boolean, data binary")


# --- texts --------------------------------------------------------------------------------------


def _repeated(block: _Block, answers: pa.Table) -> np.ndarray:
    """Where the repeated windows of a block start."""
    told, stand = [], None
    for is_told, data in zip(answers.column("told").to_pylist(), answers.column("data").to_pylist()):
        if is_told:
            told.append([np.frombuffer(p, kind) for p, kind in zip(_spread(data), ("<i4", "<i4", "<i8"))])
        else:
            stand = [np.frombuffer(p, "<i4") for p in _spread(data)]
    if not told or stand is None:
        return np.empty(0, np.int64)
    seg, lengths, windows = (np.concatenate(parts) for parts in zip(*told))
    first, held = stand
    answer = np.full(int(held.max()) + 1, -1)
    answer[seg] = np.arange(len(seg))
    asked = answer[held] >= 0
    first, which = first[asked].astype(np.int64), answer[held[asked]]
    least = windows[_filled((np.cumsum(lengths) - lengths)[which], lengths[which])]
    starts = _filled(first, lengths[which])
    return starts[least < block.docs[block.row_of(starts)]]


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    ready(docs.sparkSession)
    own = ("n_words", "n_removed", "kept_text")
    kept = [c for c in docs.columns if c not in own]
    # The row's own columns travel as one, so no name of theirs meets a name used here; the text travels once.
    row = F.struct(*[F.col(f"`{c}`") for c in [c for c in kept if c != text_col] or [id_col]])
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = materialise(_blocks(rows), "blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    ranges, shards = max(1, math.ceil(size / RANGE_BYTES)), max(1, math.ceil(size / SHARD_BYTES))
    stored = blocks.select("block", "data")
    segments = _segments(stored, _live(stored, window, ranges), window, ranges, shards)
    answers = materialise(_answers(segments, window), "answers")

    def remove(stored: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block.read(stored.column("data")[0].as_py())
        cover = np.zeros(len(block.codes) + 1, np.int8)
        starts = _repeated(block, answers)
        cover[starts] += 1
        cover[starts + window] -= 1
        stays = np.cumsum(cover, dtype=np.int64)[:-1] == 0
        ends = np.r_[0, np.cumsum(stays)][block.ends]
        words = block.vocabulary.take(pa.array(block.codes[stays]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), words), " ")
        n_words = np.diff(block.ends, prepend=0)
        return pa.table({
            "row": block.rows.column("row"), "text": block.rows.column("text"), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_words - np.diff(ends, prepend=0), pa.int64()), "kept_text": joined.cast(pa.string()),
        })

    schema = StructType([rows.schema["row"], rows.schema["text"]]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    result = stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, schema)
    return result.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in kept], *own)
