"""Byte-level BPE encoding and decoding with a local rank file.

Both directions run the tiktoken library over Arrow batches. A long text is cut before encoding at
places where no match of the split pattern can reach across, so the ids are those of the whole
text and the regular expression never runs over more than one piece. Decoding joins raw bytes,
so ids that end inside a character are fine.

Defined results: NULL and empty texts have no ids; no ids decode to no bytes; NULL ids decode to
no bytes. Rows are kept as they come, repeated or not, with all their other columns.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructType

from stagecast.llm.common import ready

#: Characters after which the next safe cut is looked for.
PIECE_CHARS = 50_000

# Letters and digits whose class is the same in every version of Unicode in use.
_L = r"[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡА-яぁ-ゖァ-ヺ一-鿌가-힣]"
_N = "[0-9]"
_P = r"[!-&(-/:-@\[-`{-~、-。！-／]"  # no apostrophe: it may start 's, 't, ..
# White space is only ever preceded, never followed, by other characters of one match; the last
# white-space character of a run belongs to what follows; no match mixes letters, digits and signs.
_SAFE = regex.compile(
    r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])"
    r"|(?<=[ \t\n\r])(?=[ \t\n\r][^\s\x1c-\x1f\x85])"
    rf"|(?<={_L})(?=[0-9]|{_P})|(?<={_N})(?={_L}|{_P})|(?<={_P})(?={_L}|{_N})"
)


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut ``text`` into pieces that encode one by one as they do together.

    A piece is longer than ``size`` only up to the next safe place; a single match of the
    pattern (a word of a million letters) is never cut.
    """
    pieces, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    pieces.append(text[start:])
    return pieces


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tokenizer of a rank file, loaded once per Python worker; it has no special tokens."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str, rank_file: str, pattern: str) -> np.ndarray:
    tokenizer = encoding(rank_file, pattern)
    return np.concatenate([np.array(tokenizer.encode_ordinary(x), dtype=np.int32) for x in safe_pieces(text)])


def bpe_encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of ``text`` as array<int>; the rank file is on every executor.

    A column that has the name ``out`` is replaced.
    """

    def encode(texts: pa.Array) -> pa.Array:
        ids = [encode_text(t or "", rank_file, pattern) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    return _with_column(df, text, out, ArrayType(IntegerType()), encode)


def bpe_decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Add ``out``, the raw bytes of the array<int> column ``ids``."""

    def decode(lists: pa.Array) -> pa.Array:
        tokenizer, flat = encoding(rank_file, pattern), lists.values.to_numpy(zero_copy_only=False)
        ends, known = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(
            [tokenizer.decode_bytes(flat[a:b].tolist() if k else []) for a, b, k in zip(ends, ends[1:], known)], pa.binary()
        )

    return _with_column(df, ids, out, BinaryType(), decode)


def _with_column(df: DataFrame, source: str, out: str, kind: DataType, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with ``out`` made batch by batch; a plan node of its own, so nothing runs twice."""
    ready(df.sparkSession)
    kept = df.select([F.col(f"`{c}`") for c in df.columns if c != out or c == source])
    schema = StructType([f for f in kept.schema if f.name != out]).add(out, kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), make(batch.column(source))], [*names, out])

    return kept.mapInArrow(add, schema)
