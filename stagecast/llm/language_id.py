"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. The probability of a text
sums over all ways to cut it into pieces. Pieces start anew at every word, so that sum is the
product over words of a forward recursion over the lattice of pieces inside the word; a word's
result for all languages is remembered by the worker. Characters without a piece are the product
of their byte pieces, so every text has a probability.

Words are runs of letters in lower case, however long. Training takes a bounded sample of labelled
documents (about ``per_language`` of each language, chosen by a 64-bit hash; words there are cut
after ``RUN`` letters) and estimates the pieces by expectation maximisation: word counts per
language are merged across tasks, and each round sends back the expected piece counts, a table
bounded by the vocabulary. Priors count all labelled documents. Prediction needs no shuffle.

Defined results: NULL texts and texts without a letter are ``und`` with score 0, and so is every
text if nothing was learned. Training rows with a NULL language or text are skipped.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from stagecast.llm.common import grouped_rows, materialise, ready

RUN = 64
_LETTERS = regex.compile(r"\p{L}+")
_SCALED = 16  # positions after which a long forward recursion is scaled
_SEGMENT = 20_000
_START = "▁"  # as the vocabulary marks the start of a word
_AT_ONCE = 8192
_REMEMBERED = 600_000
UNDETERMINED = "und"


#: Runs of letters and of the few numerals that are no digits: faster to find, and mostly the same.
_NEARLY = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    found = _NEARLY.findall(lower := text.lower())
    return found if not found or "".join(found).isalpha() else _LETTERS.findall(lower)


class Pieces:
    """The pieces of a sentencepiece model that can occur in words, by text; and its byte pieces."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.ids, self.bytes = {}, {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[model.id_to_piece(i)] = i
        self.size = model.get_piece_size()
        self.longest = max(map(len, self.ids), default=1)
        self._length = np.zeros(self.size, np.int64)
        self._length[list(self.ids.values())] = [len(piece) for piece in self.ids]

    @cached_property
    def _automaton(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            automaton.add_word(piece, i)
        automaton.make_automaton()
        return automaton

    def lattice(self, texts: list[str]) -> "Lattice":
        """All pieces in all of ``texts``; a piece's id is padded to four ids with ``size``."""
        joined = "".join(f"{_START}{text} " for text in texts)  # no piece has a space
        found = np.fromiter(chain.from_iterable(self._automaton.iter(joined)), np.int64).reshape(-1, 2)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(lengths + 1) - (lengths + 1)
        ids = np.full((len(found), 4), self.size)
        ids[:, 0] = found[:, 1]
        stop = found[:, 0] + 1
        start = stop - self._length[found[:, 1]]
        alone = np.ones(len(joined), bool)  # characters that are no piece by themselves
        alone[start[stop == start + 1]] = False
        alone[first + lengths] = False
        spelt = np.flatnonzero(alone)
        if len(spelt):
            raw = np.full((len(spelt), 4), self.size)
            for k, at in enumerate(spelt.tolist()):
                spelling = [self.bytes[b] for b in joined[at].encode("utf-8", "surrogatepass")]
                raw[k, : len(spelling)] = spelling
            ids, start, stop = np.concatenate([ids, raw]), np.r_[start, spelt], np.r_[stop, spelt + 1]
        word = np.searchsorted(first, start, side="right") - 1
        start, stop = start - first[word], stop - first[word]
        order = np.lexsort((word, stop))
        return Lattice(len(texts), lengths, stop[order], word[order], start[order], ids[order])


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


@dataclass
class Lattice:
    """Edges sorted by end, then word: ``ids`` leads from ``start`` to ``end`` in ``word``."""

    n: int
    lengths: np.ndarray
    end: np.ndarray
    word: np.ndarray
    start: np.ndarray
    ids: np.ndarray

    def forward(self, edge: np.ndarray) -> np.ndarray:
        """Sums over all segmentations up to each position; ``edge`` has a row per edge."""
        alpha = np.zeros((self.n, int(self.lengths.max(initial=0)) + 1, edge.shape[1]))
        alpha[:, 0] = 1.0
        cuts = np.searchsorted(self.end, np.arange(1, alpha.shape[1] + 1))
        for j in range(1, alpha.shape[1]):
            at = slice(cuts[j - 1], cuts[j])
            w = self.word[at]
            if len(w):
                firsts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                alpha[w[firsts], j] = np.add.reduceat(alpha[w, self.start[at]] * edge[at], firsts)
        return alpha

    def backward(self, edge: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.n, int(self.lengths.max(initial=0)) + 1, edge.shape[1]))
        beta[np.arange(self.n), self.lengths] = 1.0
        cuts = np.searchsorted(self.end, np.arange(1, beta.shape[1] + 1))
        for j in range(beta.shape[1] - 1, 0, -1):
            at = slice(cuts[j - 1], cuts[j])
            np.add.at(beta, (self.word[at], self.start[at]), beta[self.word[at], j] * edge[at])
        return beta

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(self.n), self.lengths]


@dataclass
class LanguageModel:
    """languages; log priors; probabilities, one row per piece (and one for "no piece") and a column per language."""

    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray


def train(
    labelled: DataFrame, model_file: str, per_language: int = 3_000, rounds: int = 3, smoothing: float = 0.05,
    text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """Learn from rows with a text and a language, of which about ``per_language`` of each are used."""
    spark = ready(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    docs = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    # The share of a language as a bound on its 64-bit hashes: exact however many rows there are.
    bounds = [(x, min((1 << 64) * per_language // n, (1 << 64) - 1) - (1 << 63)) for x, n in docs.items()]
    bound = F.broadcast(spark.createDataFrame(bounds, "lang string, bound long"))
    chosen = rows.join(bound, "lang").where(F.xxhash64("text") <= F.col("bound")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in grouped_rows(batches, ["text", "lang"]):
            counts = Counter((lang, w[k : k + RUN]) for text, lang in zip(texts, langs) for w in words(text) for k in range(0, len(w), RUN))
            pairs = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(counts.values(), pa.int64())],
                ["lang", "word", "n"],
            )

    table = materialise(
        chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words"
    )
    languages = sorted(docs)
    size = pieces(model_file).size
    prior = np.log([docs[x] / sum(docs.values()) for x in languages]) if languages else np.zeros(0)
    probability = np.full((size + 1, len(languages)), 1.0 / size)
    probability[size] = 1.0
    counted = table.repartition(F.col("word"))
    for _ in range(rounds if languages else 0):
        held = spark.sparkContext.broadcast((languages, probability))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, p = held.value
            place, inventory = {x: k for k, x in enumerate(names)}, pieces(model_file)
            sums = np.zeros((len(names), inventory.size + 1))
            for langs, texts, n in grouped_rows(batches, ["lang", "word", "n"]):
                lattice, lang = inventory.lattice(texts), np.array([place[x] for x in langs])
                edge = p[lattice.ids, lang[lattice.word][:, None]].prod(axis=1)[:, None]
                alpha, beta = lattice.forward(edge), lattice.backward(edge)
                weight = np.array(n)[lattice.word] / lattice.totals(alpha)[lattice.word, 0]
                share = alpha[lattice.word, lattice.start, 0] * edge[:, 0] * beta[lattice.word, lattice.end, 0] * weight
                np.add.at(sums, (lang[lattice.word][:, None], lattice.ids), share[:, None])
            lang, piece = np.nonzero(sums[:, : inventory.size])
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(piece), pa.array(sums[lang, piece])], ["lang", "piece", "n"])

        expected = counted.mapInArrow(expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros((size, len(languages)))
        sums[expected["piece"], expected["lang"]] = expected["n"]
        probability[:size] = (sums + smoothing) / (sums.sum(axis=0) + smoothing * size)
    return LanguageModel(languages, prior, probability)


class Scorer:
    """Log probabilities of words for all languages, remembered up to a bound."""

    def __init__(self, model: LanguageModel, model_file: str):
        self.model, self.pieces = model, pieces(model_file)
        self.known: dict[str, int] = {}
        self.table = np.zeros((_REMEMBERED, len(model.languages)))

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), _AT_ONCE):
            part = new[at : at + _AT_ONCE]
            lattice = self.pieces.lattice(part)
            edge = self.model.probability[lattice.ids].prod(axis=1)
            first = len(self.known)
            self.table[first : first + len(part)] = np.log(lattice.totals(lattice.forward(edge)))
            self.known.update(zip(part, range(first, first + len(part))))

    def long(self, word: str) -> np.ndarray:
        """Log probability of a word of any length: the forward vector is carried on, scaled, from position to position."""
        reach = self.pieces.longest
        alpha = np.zeros((len(word) + 2, len(self.model.languages)))
        alpha[0], scale = 1.0, np.zeros(len(self.model.languages))
        for a in range(0, len(word) + 1, _SEGMENT):  # position 0 is the start mark
            first = max(0, a - reach)
            lattice = self.pieces.lattice([word[first : a + _SEGMENT - 1]])
            edge = self.model.probability[lattice.ids].prod(axis=1)
            start, end = lattice.start + first, lattice.end + first
            # The mark in front of a later segment isn't one of the word.
            real = (end > a) & ((lattice.start > 0) | (first == 0))
            start, end, edge = start[real], end[real], edge[real]
            cuts = np.searchsorted(end, np.arange(a + 1, min(a + _SEGMENT, len(word) + 1) + 2))
            for k in range(len(cuts) - 1):
                at, j = slice(cuts[k], cuts[k + 1]), a + 1 + k
                alpha[j] = (alpha[start[at]] * edge[at]).sum(axis=0)
                if j % _SCALED == 0:
                    held = slice(max(0, j - reach), j + 1)
                    by = alpha[held].max(axis=0)
                    alpha[held] /= by
                    scale += np.log(by)
        return np.log(alpha[len(word) + 1]) + scale

    def score(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Log probability of each text by language, with the prior; None without a letter."""
        return self.score_words([words(text) for text in texts])

    def score_words(self, texts: list[list[str]]) -> Iterator[np.ndarray | None]:
        """The same for texts given as their words. New words of all texts are learned together."""
        counted = [Counter(found) for found in texts]
        every = {w for w in set(chain.from_iterable(counted)) if len(w) <= RUN}
        together = every.difference(self.known)
        if len(self.known) + len(together) > _REMEMBERED:
            self.known.clear()
            together = every
        if len(together) <= _REMEMBERED:
            self._learn(list(together))
        for counts in counted:
            total, anything = self.model.prior, bool(counts)
            for word in [w for w in counts if len(w) > RUN]:  # too rare to be remembered
                total = total + counts.pop(word) * self.long(word)
            unique = list(counts)
            for at in range(0, len(unique), _REMEMBERED):  # a long text by parts
                part = unique[at : at + _REMEMBERED]
                new = set(part).difference(self.known)
                if len(self.known) + len(new) > _REMEMBERED:
                    self.known.clear()
                    new = set(part)
                if new:
                    self._learn(list(new))
                times = np.fromiter(map(counts.__getitem__, part), np.float64, len(part))
                total = total + times @ self.table[np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))]
            yield total if anything else None


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, model: LanguageModel, model_file: str) -> Scorer:
    """The scorer of a model, kept by the worker for the tasks that follow."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model, model_file)
    return _scorers[name]


def identify(docs: DataFrame, model: LanguageModel, model_file: str, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the probability of that language among those learned.

    The text column stays behind; columns with the names of the results are replaced.
    """
    held, name = ready(docs.sparkSession).sparkContext.broadcast(model), uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, held.value, model_file)
        for batch in batches:
            names, scores = [], []
            for total in scorer.score(batch.column(len(kept)).to_pylist()):
                if total is None or not len(total):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best = int(total.argmax())
                    names.append(held.value.languages[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"]
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`"))
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[: len(kept)])
    return rows.mapInArrow(predict, f"{schema}, lang_pred string, score double" if schema else "lang_pred string, score double")
