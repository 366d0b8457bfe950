import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusrules.llm import langid as op
from made_texts import SYLLABLES, corpus


def test_held_out_accuracy(docs):
    texts, langs = corpus()
    extra = [None, "", "123 !!! 456", " ", "漢字 仮名", "Δδ", "ing and the of " * 20000]
    got = {r["doc_id"]: r for r in op.languages(docs(*texts, *extra, lang=langs + [None] * 6 + ["en"])).collect()}
    held = [k for k in range(len(texts)) if got[k]["held_out"]]
    assert len(held) > 20
    assert sum(got[k]["lang_pred"] == langs[k] for k in held) / len(held) > 0.97
    n = len(texts)
    assert [(got[n + k]["lang_pred"], got[n + k]["score"]) for k in range(4)] == [("und", 0.0)] * 4
    assert got[n + 4]["lang_pred"] in SYLLABLES and got[n + 5]["lang_pred"] in SYLLABLES and got[n + 6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_family_comes_first(docs):
    texts, langs = corpus()
    model = op.fit(docs(*texts, lang=langs))
    assert model.families == {"germanic": ("de", "en"), "romance": ("es", "fr"), "xx": ("xx",)}
    pairs = {(c.family, c.one, c.other) for c in model.classifiers}
    assert pairs == {(None, "germanic", "romance"), (None, "germanic", "xx"), (None, "romance", "xx"), ("germanic", "de", "en"), ("romance", "es", "fr")}


def test_labels_and_held_out_rows_never_matter(docs):
    texts, langs = corpus(2)
    one = {r["doc_id"]: r for r in op.languages(docs(*texts, lang=langs)).collect()}
    spoiled = ["es" if one[k]["held_out"] else lang for k, lang in enumerate(langs)]
    two = {r["doc_id"]: r for r in op.languages(docs(*texts, lang=spoiled, source=["other"] * len(texts))).collect()}
    assert one == two


def test_nothing_or_one_language_to_learn(docs):
    assert {(r["lang_pred"], r["score"]) for r in op.languages(docs("one two", "three", None)).collect()} == {("und", 0.0)}
    got = op.languages(docs("one two", "three four", None, lang=["en", "en", "en"])).collect()
    assert [r["lang_pred"] for r in got] == ["en", "en", "und"]
    assert op.languages(docs()).collect() == []


def test_filter(docs):
    texts, langs = corpus(3)
    table = docs(*texts, None, "42", lang=langs + ["en", "en"])
    kept = op.with_known_language(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(texts)))


def made_up(langs, seed=6):
    """Each language has twelve syllables of its own over the same letters."""
    rng = random.Random(seed)
    return {lang: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 3))) for _ in range(12)] for lang in langs}


# One family of eleven, eleven families of one, and five families of which one has four.
@pytest.mark.parametrize("langs", ["da de en fy is nb nl nn no sv yi en", "en fr pl hi tr fi lt ga ar xa xb xc", "da de en sv fr pl hi tr", "en", "en fr"], ids=["family", "families", "both", "one", "two"])
def test_filter_whatever_the_number_of_languages(docs, langs):
    rng, langs = random.Random(7), sorted(set(langs.split()))
    spoken = made_up(langs)
    values = [(lang, " ".join("".join(rng.choices(spoken[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(2, 60)))) for lang in langs for _ in range(30)]
    gibberish = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(40)) for _ in range(20)]
    half = [values[k][1] + " " + gibberish[k][: len(values[k][1])] for k in range(0, 20)]
    texts = [t for _, t in values] + half + ["q", "Zq"] + gibberish
    kept = sorted(r["doc_id"] for r in op.with_known_language(docs(*texts, lang=[lang for lang, _ in values] + [None] * (len(texts) - len(values)))).collect())
    assert kept == list(range(len(texts) - len(gibberish)))


def test_trigrams_stay_within_texts():
    texts = pa.array(["abc", "", None, "de", "fabcabc"])
    shares = op.trigram_shares(texts)
    alone = [op.trigram_shares(pa.array([t]))[0] for t in texts.to_pylist()]
    assert all((a == b).all() for a, b in zip(shares, alone, strict=True))
    assert [round(float(s.sum()), 4) for s in shares] == [op.SCALE, 0, 0, 0, op.SCALE]


def test_against_plain_python(docs):
    """Scores worked out again: trigrams counted one by one, machines fitted on all rows at once, votes of each level."""
    texts, langs = corpus(6, 30)
    got = {r["doc_id"]: r for r in op.languages(docs(*texts, lang=langs)).collect()}

    def features(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        counts = np.zeros(op.BINS)
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            code = a | b << 8 | c << 16
            mixed = (code * 0x9E3779B1 & 0xFFFFFFFF) ^ ((code >> 7) * 0x85EBCA6B & 0xFFFFFFFF)
            counts[mixed >> 13 & op.BINS - 1] += 1
        return counts * op.SCALE / max(1, len(raw) - 2)

    x = np.array([features(t) for t in texts])
    learned = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5]
    place = op.family_of()

    def margin(one, other, of):
        rows = [k for k in learned if of(langs[k]) in (one, other)]
        y = np.array([1.0 if of(langs[k]) == one else -1.0 for k in rows], np.float32)
        w, b = op.fit_svm(op.Rows([x[rows].astype(np.float32)]), y)
        return 1 / (1 + np.exp(-op.STEEPNESS * (x @ w.astype(float) + b)))

    def level(names, of):
        votes = {n: np.zeros(len(x)) for n in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                vote = margin(a, b, of)
                votes[a] += vote
                votes[b] += 1 - vote
        total = sum(votes.values()) if len(names) > 1 else 1
        return {n: votes[n] / total if len(names) > 1 else np.ones(len(x)) for n in names}

    families = level(sorted({place.get(lang, lang) for lang in langs}), lambda lang: place.get(lang, lang))
    within = {f: level(sorted({lang for lang in langs if place.get(lang, lang) == f}), lambda lang: lang) for f in families}
    for k in range(len(texts)):
        family = max(families, key=lambda f: families[f][k])
        lang = max(within[family], key=lambda n: within[family][n][k])
        assert got[k]["lang_pred"] == lang and got[k]["score"] == pytest.approx(families[family][k] * within[family][lang][k], abs=1e-3)
