"""Hashes of words and of runs of words, as NumPy arrays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from stagecast.llm.common import WORD

_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_list(text: str | None, lower: bool = False) -> list[str]:
    """Words of a text; with ``lower`` A-Z are lower-cased first."""
    if not text:
        return []
    if lower:
        text = text.encode("utf-8", "surrogatepass").translate(_TO_LOWER).decode("utf-8", "surrogatepass")
    return WORD.findall(text)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * _STEP + hashes[k : len(hashes) - n + 1 + k]
    return mixed(total + np.uint64(n))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of all words if there are fewer."""
    hashes = word_hashes(word_list(text, lower=True))
    if not len(hashes):
        return hashes
    return np.unique(run_hashes(hashes, min(n, len(hashes))))


# --- counts of hashed tokens in a fixed number of slots -----------------------------------------

_RANGES = 64
_FLUSH = 1_500_000
_BLOBS = "range int, wide int, gaps binary, counts binary"


def _blobs(slots: np.ndarray, bits: int) -> pa.RecordBatch:
    """Slots with their counts as gaps between neighbours, one row for each range of slots."""
    found, counts = np.unique(slots, return_counts=True)
    cuts = np.searchsorted(found, np.arange(_RANGES + 1, dtype=np.uint64) << np.uint64(bits - 6))
    rows = []
    for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            gaps = np.diff(found[a:b], prepend=np.uint64(r << (bits - 6)))
            wide = 4 if int(gaps.max()) > 65535 or int(counts[a:b].max()) > 65535 else 2
            kind = f"<u{wide}"
            rows.append((r, wide, gaps.astype(kind).tobytes(), counts[a:b].astype(kind).tobytes()))
    columns = zip(*rows) if rows else ((), (), (), ())
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["range", "wide", "gaps", "counts"])


def _summaries(
    rows, tokens: Callable[[pa.RecordBatch], np.ndarray], bits: int, keep: Callable[[int, np.ndarray], bytes]
) -> DataFrame:
    """range, summary: what ``keep`` makes of the counts of each range of slots that has tokens."""
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(tokens(batch) >> shift)
            n += len(held[-1])
            if n > _FLUSH:
                yield _blobs(np.concatenate(held), bits)
                held, n = [], 0
        if n:
            yield _blobs(np.concatenate(held), bits)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << (bits - 6), np.uint32)
        for batch in batches:
            for wide, gaps, more in zip(*(batch.column(c).to_pylist() for c in ("wide", "gaps", "counts"))):
                at = np.cumsum(np.frombuffer(gaps, f"<u{wide}").astype(np.int64))
                # Counts stop at the largest number instead of beginning anew.
                total = counts[at].astype(np.uint64) + np.frombuffer(more, f"<u{wide}")
                counts[at] = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([keep(key[0].as_py(), counts)], pa.binary())], ["range", "summary"]
        )

    add.__annotations__ = {
        "key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]
    }
    return rows.mapInArrow(count, _BLOBS).groupBy("range").applyInArrow(add, "range int, summary binary")


def slot_summary(
    rows, tokens: Callable[[pa.RecordBatch], np.ndarray], bits: int, summarise: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Count hashed tokens of all rows (a DataFrame, or what has its ``mapInArrow``) in 2**bits slots (a token's slot is its top bits).

    A slot's count is that of its tokens together, so at least that of each. Tasks merge what
    they have read before the shuffle and send a few bytes per token; each range of slots is added
    up by one task. ``summarise`` turns the counts of a range into bytes. What comes back has a
    fixed size, whatever the input.
    """
    got = _summaries(rows, tokens, bits, lambda _, counts: summarise(counts).tobytes()).collect()
    empty = summarise(np.zeros(1 << (bits - 6), np.uint32))
    parts = {r["range"]: np.frombuffer(r["summary"], empty.dtype) for r in got}
    return np.concatenate([parts.get(r, empty) for r in range(_RANGES)])


#: The last table that this process has read.
_read: dict[str, np.ndarray] = {}


def forget() -> None:
    """Let go of the table that this process has read."""
    _read.clear()


@dataclass(frozen=True)
class SlotTable:
    """A :func:`slot_summary` in a shared folder, a file per range, which no one but tasks write or read."""

    folder: str
    empty: np.ndarray

    @classmethod
    def of(
        cls, rows, tokens: Callable[[pa.RecordBatch], np.ndarray], bits: int, summarise: Callable[[np.ndarray], np.ndarray], folder: str
    ) -> SlotTable:
        place = re.sub("^file:/+", "/", folder)

        def keep(part: int, counts: np.ndarray) -> bytes:
            files, root = pa_fs.FileSystem.from_uri(place)
            files.create_dir(root, recursive=True)
            # A task that runs twice leaves one whole file.
            own = f"{root}/.{part}-{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(own) as out:
                out.write(summarise(counts).tobytes())
            files.move(own, f"{root}/{part}")
            return b""

        _summaries(rows, tokens, bits, keep).agg(F.count(F.lit(1))).collect()
        return cls(place, summarise(np.zeros(1 << (bits - 6), np.uint32)))

    def read(self) -> np.ndarray:
        """The whole table, once per process."""
        if self.folder not in _read:
            files, root = pa_fs.FileSystem.from_uri(self.folder)
            table = np.tile(self.empty, _RANGES)
            for part in files.get_file_info(pa_fs.FileSelector(root, allow_not_found=True)):
                if part.base_name.isdigit():
                    at = int(part.base_name) * len(self.empty)
                    with files.open_input_stream(part.path) as found:
                        table[at : at + len(self.empty)] = np.frombuffer(found.read(), self.empty.dtype)
            _read.clear()
            _read[self.folder] = table
        return _read[self.folder]
