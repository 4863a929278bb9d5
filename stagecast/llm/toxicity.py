"""Toxicity by the nearest labelled examples, with evidence.

A text is compared with labelled ones by the cosine of their TF-IDF vectors. Terms are words and
beginnings of words, so that inflected and compound forms meet; only terms that go with one label
far more often than chance allows make up the vectors, else the ordinary words of a long text would
outvote the few that matter.

The labelled vectors form an inverted index in blocks of ``BLOCK`` examples, with the largest
weight of every term in every block. The sum of these maxima bounds each example of a block, so
blocks are scored from the highest bound down until none can hold one of the ``neighbours`` nearest;
nothing is approximated. Of equal cosines the example that comes first in the index counts.

The neighbours vote with their cosine as weight, beside a few votes of the prior. Votes become
probabilities by isotonic regression over the labelled texts, each scored without itself.

The index is fitted on a bounded sample: at most ``per_class`` examples of each label (the smallest
64-bit hashes of their identifiers), each standing for its share of the label; and at most
``max_terms`` terms. Everything else reads all rows.

Defined results: NULL and empty texts, and texts without any of the terms, have the score of
labelled texts without terms. Rows are kept as they come, repeated or with NULL identifiers. An
example needs an identifier and a label; if one identifier has several labels the larger counts.
Without examples of both labels every score is the share of the label there is, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stagecast.llm.common import materialise, ready

BLOCK = 64
#: Bounds of the fitted model.
PER_CLASS, MAX_TERMS = 10_000, 20_000
#: A term is kept if its likelihood ratio statistic and its ratio of rates reach these.
LEAST_G2, LEAST_RATIO = 30.0, 2.0
#: Beginnings of words that are terms, in letters.
PREFIXES = range(4, 10)
#: Words and vectors that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Votes of the prior beside those of the neighbours.
PRIOR_VOTES = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[int]:
    """Hashes of a word and its beginnings."""
    spelt = [f"w{word}", *(f"p{word[:k]}" for k in PREFIXES if k < len(word))]
    return [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in spelt]


def words_in(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


class Terms:
    """Finds the known terms of texts; remembers the words it has met."""

    def __init__(self, numbers: dict[int, int]):
        self._numbers, self._words = numbers, {}

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """(term number, occurrences), by number."""
        found: dict[int, int] = {}
        if len(self._words) > REMEMBERED:
            self._words.clear()
        for word, n in words_in(text).items():
            known = self._words.get(word)
            if known is None:
                known = self._words[word] = tuple(self._numbers[t] for t in terms_of(word) if t in self._numbers)
            for t in known:
                found[t] = found.get(t, 0) + n
        return tuple(sorted(found.items()))


@dataclass
class Index:
    """Block-max inverted index of unit vectors, with the label and the weight of each example."""

    vectors: list[tuple[np.ndarray, np.ndarray]]
    labels: np.ndarray
    shares: np.ndarray
    n_terms: int
    postings: list = field(init=False)
    maxima: list = field(init=False)

    def __post_init__(self) -> None:
        rows = [[] for _ in range(self.n_terms)]
        for k, (terms, weights) in enumerate(self.vectors):
            for t, w in zip(terms.tolist(), weights.tolist()):
                rows[t].append((k, w))
        self.postings = [(np.array([k for k, _ in r], np.int64), np.array([w for _, w in r])) for r in rows]
        self.maxima = []
        for at, weights in self.postings:
            heads = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
            self.maxima.append((at[heads] // BLOCK, np.maximum.reduceat(weights, heads) if len(at) else weights))
        self.n_blocks = -(-len(self.labels) // BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine and the cosines; ``without`` leaves one out."""
        bounds = np.zeros(self.n_blocks)
        for t, w in zip(terms, weights):
            blocks, most = self.maxima[t]
            bounds[blocks] += w * most
        live = np.flatnonzero(bounds > 0)
        order = live[np.lexsort((live, -bounds[live]))]
        best, cosines, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(order):
            # A bound is a sum in another order than the cosine: leave room for rounding.
            if len(best) == k and bounds[order[at]] < cosines[-1] - 1e-9:
                break
            chosen = order[at : at + step]
            found, value = self._score(np.sort(chosen), terms, weights, without)
            best, cosines = np.concatenate([best, found]), np.concatenate([cosines, value])
            top = np.lexsort((best, -cosines))[:k]
            best, cosines, at, step = best[top], cosines[top], at + step, step * 4
        return best, cosines

    def _score(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of the examples of some blocks, where positive."""
        slot = np.full(self.n_blocks, -1)
        slot[blocks] = np.arange(len(blocks))
        sums = np.zeros(len(blocks) * BLOCK)
        for t, w in zip(terms, weights):
            at, held = self.postings[t]
            if len(blocks) * 4 < self.n_blocks:  # a few blocks: cut them out of the postings
                cuts = np.searchsorted(at, np.concatenate([blocks * BLOCK, blocks * BLOCK + BLOCK]))
                a, b = cuts[: len(blocks)], cuts[len(blocks) :]
                part = np.concatenate([np.arange(x, y) for x, y in zip(a, b) if x < y] or [np.zeros(0, np.int64)])
                at, held = at[part], held[part]
            place = slot[at // BLOCK]
            inside = place >= 0
            sums[place[inside] * BLOCK + at[inside] % BLOCK] += w * held[inside]
        found = np.flatnonzero(sums > 0)
        ids = blocks[found // BLOCK] * BLOCK + found % BLOCK
        kept = ids != without
        # Cosines that differ by rounding only are equal.
        return ids[kept], np.round(sums[found][kept], 9)


@dataclass
class Model:
    """What is sent to the tasks; its size is bounded by ``per_class`` and ``max_terms``."""

    numbers: dict[int, int]
    idf: np.ndarray
    index: Index
    doc_ids: np.ndarray
    neighbours: int
    prior: float
    steps: tuple[np.ndarray, np.ndarray]

    def vector(self, counts: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector."""
        terms = np.array([t for t, _ in counts], np.int64)
        weights = np.array([1.0 + math.log(n) for _, n in counts]) * self.idf[terms]
        length = math.sqrt(float((weights**2).sum()))
        return terms, weights / length if length else weights

    def vote(self, counts: tuple[tuple[int, int], ...], without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted share of the label among the nearest examples, and these with their cosines."""
        terms, weights = self.vector(counts)
        near, cosines = self.index.nearest(terms, weights, self.neighbours, without)
        votes = cosines * self.index.shares[near]
        scale = float(self.index.shares.mean()) if len(self.index.shares) else 1.0
        total = float(votes.sum()) + PRIOR_VOTES * scale
        return (float(votes @ self.index.labels[near]) + PRIOR_VOTES * scale * self.prior) / total, near, cosines

    def probability(self, vote: float, empty: bool) -> float:
        at, value = self.steps
        if empty or not len(at):
            return float(value[0]) if empty and len(value) else self.prior
        return float(np.interp(vote, at[1:], value[1:])) if len(at) > 1 else self.prior


def isotonic(votes: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps (vote, probability) that fit the weighted labels best."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []  # sum of label * weight, weight, sum of vote * weight
    for v, y, w in zip(votes[order].tolist(), labels[order].tolist(), shares[order].tolist()):
        blocks.append([y * w, w, v * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([v / w for _, w, v in blocks]), np.array([y / w for y, w, _ in blocks])


def _examples(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Sampled texts with their label, and how many examples each of them stands for."""
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    shares = {c: max(1.0, n / per_class) for c, n in sizes.items()}
    chosen = None
    for c in sizes:  # two labels
        part = one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = one
    # At most two times per_class rows, so they may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(materialise(chosen, "label-sample")), "doc_id")
    return materialise(rows, "label-texts"), shares


def _term_rates(examples: DataFrame) -> DataFrame:
    """term, label, n: examples with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        known: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms: set[int] = set()
                for word in words_in(text):
                    if word not in known:
                        if len(known) > REMEMBERED:
                            known.clear()
                        known[word] = terms_of(word)
                    terms.update(known[word])
                found[label].update(terms)
            if max(map(len, found.values())) > 1_000_000:
                yield from _batches(found)
                found = {0: Counter(), 1: Counter()}
        yield from _batches(found)

    def _batches(found: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for label, terms in found.items():
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(terms), pa.int64()), pa.array([label] * len(terms), pa.int32()), pa.array(list(terms.values()), pa.int64())],
                    ["term", "label", "n"],
                )

    counted = examples.select("text", "label").mapInArrow(count, "term long, label int, n long")
    return counted.groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"),
    )


def _telling(rates: DataFrame, n0: int, n1: int, max_terms: int) -> DataFrame:
    """Terms whose rates under the two labels differ significantly and widely."""
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    share = (a + b) / F.lit(float(n0 + n1))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (
        part(a, share * n1) + part(b, share * n0)
        + part(F.lit(float(n1)) - a, (1 - share) * n1) + part(F.lit(float(n0)) - b, (1 - share) * n0)
    )
    ratio = ((a + 0.5) / (n1 + 1.0)) / ((b + 0.5) / (n0 + 1.0))
    return (
        rates.withColumn("g2", g2).where((F.col("g2") >= LEAST_G2) & (F.abs(F.log(ratio)) >= math.log(LEAST_RATIO)))
        .orderBy(F.col("g2").desc(), "term").limit(max_terms)
    )


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", neighbours: int = 15, per_class: int = PER_CLASS, max_terms: int = MAX_TERMS,
) -> Model:
    """The index of a bounded sample of labelled texts, and its calibration."""
    spark = ready(docs.sparkSession)
    examples, shares = _examples(docs, labels, label, per_class)
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    weight = {c: sizes[c] * shares[c] for c in sizes}
    prior = weight.get(1, 0.0) / sum(weight.values()) if weight else 0.0
    empty = Index([], np.zeros(0), np.zeros(0), 0)
    none = np.zeros(0)
    if not n0 or not n1:
        return Model({}, none, empty, np.zeros(0, np.int64), neighbours, prior, (none, none))
    telling = _telling(_term_rates(examples), n0, n1, max_terms).select("term", "n0", "n1").collect()  # at most max_terms rows
    numbers = {r["term"]: k for k, r in enumerate(telling)}
    total = sum(weight.values())
    idf = np.array([math.log((1 + total) / (1 + r["n0"] * shares[0] + r["n1"] * shares[1])) + 1 for r in telling])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(numbers)
        for batch in batches:
            counts = [terms.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([[t for t, _ in c] for c in counts], pa.list_(pa.int64())),
                 pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int64()))], ["doc_id", "label", "terms", "times"],
            )

    # At most two times per_class rows of few terms each: a bounded sample, as documented.
    found = examples.select("doc_id", "text", "label").mapInArrow(find, "doc_id long, label int, terms array<long>, times array<long>").collect()
    counts = [tuple(zip(r["terms"], r["times"])) for r in found]
    # Examples with the same heaviest term come together, which keeps the maxima of the blocks apart.
    heaviest = [max(c, key=lambda x: (1 + math.log(x[1])) * idf[x[0]])[0] if c else -1 for c in counts]
    order = sorted(range(len(found)), key=lambda k: (heaviest[k], found[k]["label"], counts[k], found[k]["doc_id"]))
    counts, found = [counts[k] for k in order], [found[k] for k in order]
    model = Model(numbers, idf, empty, np.array([r["doc_id"] for r in found], np.int64), neighbours, prior, (none, none))
    label_of = np.array([float(r["label"]) for r in found])
    share_of = np.array([shares[r["label"]] for r in found])
    model.index = Index([model.vector(c) for c in counts], label_of, share_of, len(idf))
    bare = np.array([not c for c in counts])
    sent = spark.sparkContext.broadcast((model, counts))

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = sent.value
        for batch in batches:
            numbers_ = batch.column(0).to_pylist()
            votes = [held.vote(known[k], k)[0] for k in numbers_]
            yield pa.RecordBatch.from_arrays([pa.array(numbers_, pa.int64()), pa.array(votes, pa.float64())], ["k", "vote"])

    votes = np.zeros(len(found))
    for r in spark.range(len(found)).toDF("k").mapInArrow(leave_one_out, "k long, vote double").collect():
        votes[r["k"]] = r["vote"]
    sent.unpersist()
    # The first step is for texts without terms.
    rate = float((label_of[bare] * share_of[bare]).sum() + prior) / float(share_of[bare].sum() + 1)
    at, value = isotonic(votes[~bare], label_of[~bare], share_of[~bare])
    model.steps = np.concatenate([[-1.0], at]), np.concatenate([[rate], value])
    return model


def score(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """All columns but the text, then ``score``, ``predicted`` and the nearest examples as ``evidence``.

    Columns of the input with these names are replaced.
    """
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    made = ("score", "predicted", "evidence")
    kept = [c for c in docs.columns if c != "text" and c not in made]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select([F.col(f"`{c}`") for c in kept]).schema.fields)
    schema = f"{fields}{', ' if kept else ''}score double, predicted int, evidence array<struct<doc_id: long, cosine: double, label: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        terms, known = Terms(held.numbers), {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            scores, why = [], []
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                counts = terms.counts(text)
                if counts not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    vote, near, cosines = held.vote(counts)
                    known[counts] = held.probability(vote, not counts), [
                        {"doc_id": int(held.doc_ids[k]), "cosine": float(c), "label": int(held.index.labels[k])}
                        for k, c in zip(near[:evidence], cosines)
                    ]
                scores.append(known[counts][0])
                why.append(known[counts][1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(why, kind)], [*kept, *made],
            )

    return docs.select([F.col(f"`{c}`") for c in [*kept, "text"]]).mapInArrow(run, schema)
