"""Scoring texts with a hidden Markov language model.

A text is its words, then one end. Latent states emit the ``vocabulary`` most frequent words, the
end, or "rare", which stands for every other word with its share among rare words; so each
text has a proper probability. Words with few or no occurrences need their exact counts; those are joined,
never sent to all tasks.

Training is Baum-Welch: tasks run the forward-backward recursion over their texts and send
expected counts, added up by ranges of the vocabulary. ``warm_rounds`` rounds, each over its own
part of the training texts and together over all of them, separate the states first; then ``rounds``
run over every training text. For training, a text is cut after ``CUT`` tokens, and what was cut off starts from the stationary distribution of
the states. Scoring is the scaled forward recursion over the whole text.

Defined results: NULL and empty texts are one end. Rows are scored as they come. A row with a NULL
identifier counts as identifier '' when rows are held out. With nothing to learn from, every word
is unknown and the base probability of a token is 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stagecast.llm.common import grouped_rows, materialise, ready
from stagecast.llm.shingles import word_list

STATES = 6
VOCABULARY = 131_072
#: Occurrences that a word of the vocabulary has at least; rarer ones teach what rare words are like.
LEAST = 3
CUT = 256
#: A word of no text, for the end.
END = "\n"
ADD = 0.1
_RANGE = 4096
_SEQUENCES = 2048


@dataclass
class Counts:
    """The frequent words with their counts, and totals over all training tokens, the end included."""

    words: list[str]
    n: np.ndarray
    n_end: int
    total: int
    distinct: int

    @property
    def rare(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1

    def base(self) -> np.ndarray:
        """log10 of the base probability of each vocabulary item; 0 for "rare"."""
        n = np.r_[self.n, 0, self.n_end]
        logs = np.log10((n + ADD) / (self.total + ADD * (self.distinct + 1)))
        logs[self.rare] = 0.0
        return logs

    def share(self) -> np.ndarray:
        """Share of each vocabulary item, "rare" and the end among all tokens, smoothed."""
        n = np.r_[self.n, self.total - self.n.sum() - self.n_end, self.n_end] + ADD
        return n / n.sum()


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all of ``texts``, with one end for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (column,) in grouped_rows(batches, ["text"]):
            counts = Counter({END: len(column)})
            for text in column:
                counts.update(word_list(text, lower=True))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, vocabulary: int) -> Counts:
    total, distinct, n_end = counted.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    top = counted.where((F.col("word") != END) & (F.col("n") >= LEAST)).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    return Counts([r.word for r in top], np.array([r.n for r in top], dtype=np.int64), n_end or 0, total or 0, distinct)


@dataclass
class Model:
    """start and transitions of the states, and emission of each vocabulary item (a row) by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def stationary(self) -> np.ndarray:
        p = np.full(len(self.start), 1.0 / len(self.start))
        for _ in range(50):
            p = p @ self.move
        return p / p.sum()


def initial(share: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(size=(len(share), states)))
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1.0 / states), move, emit / emit.sum(axis=0))


def log_likelihood(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of whole sequences by the scaled forward recursion, all at once."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    flat, starts = np.concatenate(sequences), (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max()) + 1), side="right")
    total = np.zeros(len(sequences))
    alpha = np.tile(model.start, (len(sequences), 1))
    for t, n in enumerate(active.tolist()):
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ model.move) * model.emit[flat[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions; ``fresh`` tells which sequences begin a text."""
    states, items = len(model.start), len(model.emit)
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((items, states))
    rest = model.stationary()
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for at in range(0, len(order), _SEQUENCES):
        part = [sequences[i] for i in order[at : at + _SEQUENCES]]
        begins = fresh[order[at : at + _SEQUENCES]]
        lengths = np.array([len(s) for s in part])
        tokens = np.zeros((lengths[0], len(part)), np.int64)
        for b, s in enumerate(part):
            tokens[: len(s), b] = s
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right").tolist()
        seen = model.emit[tokens]
        alpha, scale = np.zeros(seen.shape), np.ones(tokens.shape)
        now = np.where(begins[:, None], model.start, rest)
        for t, n in enumerate(active):
            now = (now[:n] if t == 0 else now[:n] @ model.move) * seen[t, :n]
            scale[t, :n] = now.sum(axis=1)
            now = now / scale[t, :n, None]
            alpha[t, :n] = now
        beta = np.ones((len(part), states))
        for t in range(lengths[0] - 1, -1, -1):
            n, later = active[t], active[t + 1] if t + 1 < lengths[0] else 0
            if later:
                ahead = seen[t + 1, :later] * beta[:later] / scale[t + 1, :later, None]
                moves += alpha[t, :later].T @ ahead * model.move
                beta[:later] = ahead @ model.move.T
            alpha[t, :n] *= beta[:n]
        starts += alpha[0][begins].sum(axis=0)
        inside = np.arange(lengths[0])[:, None] < lengths
        chosen, weight = tokens[inside], alpha[inside]
        for s in range(states):
            emits[:, s] += np.bincount(chosen, weights=weight[:, s], minlength=items)
    return starts, moves, emits


def _cut(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [s[a : a + CUT] for s in sequences for a in range(0, len(s), CUT)]
    fresh = np.array([a == 0 for s in sequences for a in range(0, len(s), CUT)])
    return parts, fresh


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def baum_welch(encoded: DataFrame, model: Model, share: np.ndarray, general: float = 0.1) -> Model:
    """One round over all of ``encoded`` (ids); ``general`` of each state's mass goes by overall shares."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = held.value, None
        for batch in batches:
            if batch.num_rows:
                got = expected_counts(model, *_cut(_lists(batch.column("ids"))))
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
        if sums is None:
            return
        starts, moves, emits = sums
        rows = [(-1, b"", np.vstack([starts, moves]).tobytes())]
        for first in range(0, len(emits), _RANGE):
            part = emits[first : first + _RANGE]
            used = np.flatnonzero(part.any(axis=1)).astype(np.int32)
            rows.append((first, used.tobytes(), part[used].astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
            ["first", "used", "sums"],
        )

    states, items = len(model.start), len(model.emit)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            total = sum(np.frombuffer(b, np.float64) for b in rows["sums"])
        else:
            total = np.zeros((_RANGE, states))
            for used, sums in zip(rows["used"], rows["sums"]):
                total[np.frombuffer(used, np.int32)] += np.frombuffer(sums, np.float32).reshape(-1, states)
        return pd.DataFrame({"first": [key[0]], "total": [np.asarray(total).tobytes()]})

    got = encoded.select("ids").mapInArrow(expect, "first long, used binary, sums binary").groupBy("first").applyInPandas(add, "first long, total binary").collect()
    if not got:
        return model
    parts = {r["first"]: np.frombuffer(r["total"], np.float64).reshape(-1, states) for r in got}
    starts, moves = parts[-1][0], parts[-1][1:]
    emits = np.concatenate([parts[first] for first in range(0, items, _RANGE)])[:items] + 1e-9
    emits = (1 - general) * emits / emits.sum(axis=0) + general * share[:, None]
    return Model((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emits)


def score(
    docs: DataFrame, held_out: str, vocabulary: int = VOCABULARY, warm_texts: int | None = None, warm_rounds: int = 5, rounds: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out`` is a boolean
    column of ``docs`` that keeps a row out of training. With ``warm_texts`` the warm rounds all run over
    about that many texts instead of over parts of all."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    counted = materialise(count_words(rows.where("NOT held_out")), "word-counts")
    counts = frequent(counted, vocabulary)
    held = spark.sparkContext.broadcast(counts.words)
    rare, end = counts.rare, counts.end

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(held.value)}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, others = [], []
            for text in batch.column("text").to_pylist():
                words = word_list(text, lower=True)
                ids.append(np.array([*(index.get(w, rare) for w in words), end], dtype=np.int32))
                others.append([words[i] for i in np.flatnonzero(ids[-1] == rare)])
            offsets = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column("id"), batch.column("held_out"),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *ids]))), pa.array(others, pa.list_(pa.string())),
                ],
                ["row", "id", "held_out", "ids", "others"],
            )
            row += batch.num_rows

    kind = dict(rows.dtypes)["id"]
    encoded = materialise(rows.mapInArrow(encode, f"row long, id {kind}, held_out boolean, ids array<int>, others array<string>"), "encoded")
    training, share = encoded.where("NOT held_out"), counts.share()
    model, n = initial(share), max(counts.n_end, 1)
    # By a hash of the text's ids, so that the choice doesn't depend on how rows are dealt out.
    if warm_texts is None:
        warm = [training.where(F.pmod(F.xxhash64("ids"), F.lit(warm_rounds)) == k) for k in range(warm_rounds)]
    else:
        bound = min((1 << 64) * warm_texts // n, (1 << 64) - 1) - (1 << 63)
        warm = [materialise(training.where(F.xxhash64("ids") <= F.lit(bound)).select("ids"), "warm")] * warm_rounds
    for texts in [*warm, *[training] * rounds]:
        model = baum_welch(texts, model, share)

    n_rare = counts.total - int(counts.n.sum()) - counts.n_end
    kinds_rare = counts.distinct - len(counts.words) - (counts.n_end > 0)
    c = F.coalesce(F.col("n"), F.lit(0))
    of_rare = (
        encoded.select("row", F.explode("others").alias("word")).join(counted, "word", "left").groupBy("row").agg(
            F.sum(F.log10((c + ADD) / (counts.total + ADD * (counts.distinct + 1)))).alias("rare_base"),
            F.sum(F.log10((c + ADD) / (n_rare + ADD * (kinds_rare + 1)))).alias("rare_score"),
            F.count_if(c > 0).alias("rare_known"),
        )
    )
    sent = spark.sparkContext.broadcast((model, counts.base(), counts.n_end > 0))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base, end_known = sent.value
        for batch in batches:
            if batch.num_rows:
                ids = _lists(batch.column("ids"))
                own = np.add.reduceat(base[np.concatenate(ids)], np.cumsum([0, *map(len, ids[:-1])]))
                known = [int((i < rare).sum()) + end_known for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("row", "id", "held_out")), pa.array(map(len, ids), pa.int64()), pa.array(known, pa.int64()),
                        pa.array(own), pa.array(log_likelihood(model, ids) / np.log(10)),
                    ],
                    ["row", "id", "held_out", "n_tokens", "known", "base", "own"],
                )

    scored = encoded.drop("others").mapInArrow(
        forward, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, own double"
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.join(of_rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("own") + zero("rare_score")).alias("score"),
    )
