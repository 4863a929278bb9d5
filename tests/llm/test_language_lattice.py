"""Sums over all segmentations by enumeration, long words, and how the model is sampled."""

import numpy as np
import public_tokenizers
import pytest

from stagecast.llm import language_id
from stagecast.llm.language_id import LanguageModel, Scorer, pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    rng, size = np.random.default_rng(2), pieces(FILE).size
    probability = rng.random((size + 1, 3)) / size * 50
    probability[size] = 1.0
    return LanguageModel(["de", "en", "fr"], np.log([0.5, 0.3, 0.2]), probability)


def enumerated(word, probability):
    """The sum over every way to cut the word, one by one; characters that are no piece are bytes."""
    held, text = pieces(FILE), "▁" + word

    def cuts(at):
        if at == len(text):
            yield np.ones(probability.shape[1])
            return
        for end in range(at + 1, len(text) + 1):
            i = held.ids.get(text[at:end])
            if i is not None:
                p = probability[i]
            elif end == at + 1:
                p = np.prod([probability[held.bytes[b]] for b in text[at].encode()], axis=0)
            else:
                continue
            for rest in cuts(end):
                yield p * rest

    return np.log(sum(cuts(0)))


@pytest.mark.parametrize("word", ["a", "river", "überfluß", "naïveté", "日本語の", "ħəʒ", "𐎀𐎁x"])
def test_all_segmentations(model, word):
    scorer = Scorer(model, FILE)
    want = model.prior + enumerated(word, model.probability)
    assert next(scorer.score([word])) == pytest.approx(want)
    assert model.prior + scorer.long(word) == pytest.approx(want)


def test_long_words_are_not_cut(model, monkeypatch):
    monkeypatch.setattr(language_id, "_SEGMENT", 37)
    word = "hydrologischewasserstandsvorhersagenübersichtskartenverzeichnis" * 2
    scorer = Scorer(model, FILE)
    lattice = scorer.pieces.lattice([word])
    edge = model.probability[lattice.ids].prod(axis=1)
    assert scorer.long(word) == pytest.approx(np.log(lattice.totals(lattice.forward(edge)))[0])
    huge = scorer.long("abcdef" * 5000)
    assert np.isfinite(huge).all() and (huge < -1000).all()
    assert next(scorer.score([word + " 12"])) == pytest.approx(model.prior + scorer.long(word))


def test_every_language_is_learned(spark):
    """A language with a hundredth of the rows keeps its quota; a name clash is carried."""
    rows = [(f"the water level {k}", "en") for k in range(900)] + [(f"der wasserstand {k}", "de") for k in range(9)] + [(None, "fr"), ("x", None)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), FILE, per_language=20)
    assert model.languages == ["de", "en"] and np.exp(model.prior) == pytest.approx([9 / 909, 900 / 909])
    docs = spark.createDataFrame([(1, "wasserstand wasserstand", "kept"), (2, None, "kept"), (3, "water", "kept")], "doc_id long, text string, _text string")
    got = {r.doc_id: (r.lang_pred, r["_text"]) for r in language_id.identify(docs, model, FILE).collect()}
    assert got == {1: ("de", "kept"), 2: ("und", "kept"), 3: ("en", "kept")}
