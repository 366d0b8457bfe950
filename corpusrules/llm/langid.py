"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it.

Features are shares of hashed byte trigrams of the lower-cased whole text (``BINS`` of them).  Both levels are linear
support vector machines, one per pair of families and one per pair of languages of a family, so closely related languages
get weights of their own.  Each is fitted in a task of its own on a bounded sample of labelled rows: about ``PER_CLASS``
documents of each language, by a hash of the id against the language's number of documents.  A pair's vote is a logistic
function of its margin; a class's probability is its votes' share, and the score is that of the family times that of the
language.

Families come from ``FAMILIES``; a language that is not in it is a family of its own.

Null texts and texts without letters are ``und`` with score 0; so is everything when nothing could be learned.  Rows with
a null language, or a text without letters, are not learned from.  A single class wins with probability 1; equal votes go
to the smaller name.  Other columns are not read.

A score depends on the number of classes, so it does not tell whether a text is in its language at all.  ``likeness`` does:
each language has a profile (the shares of the trigrams in its sampled rows), and a text is held to be in the language it
was given if half a mixture of that profile and of trigrams drawn evenly explains it no worse than even draws alone do.
Other languages do not enter, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrules.llm.storage import free_name
from corpusrules.llm.words import _LOWER, pieces, release, released, row_sums, text_buffer

BINS = 1 << 12
PER_CLASS = 1000
UNKNOWN = "und"
#: Features are scaled so that a text's vector is about one long.
SCALE = 10.0
PENALTY = 1e-3
STEPS = 300
STEEPNESS = 2.0
#: Trigrams that a row counts for in a profile at most, so that no long text speaks for a language; seen before any row.
PROFILE_TRIGRAMS, PRIOR = 1000, 0.5

#: Families of common languages.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "semitic": ("ar", "he", "mt"),
}

GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_GUESS_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def family_of(families: Mapping[str, tuple[str, ...]] = FAMILIES) -> dict[str, str]:
    return {lang: family for family, langs in families.items() for lang in langs}


def has_letters(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    flat, bounds = text_buffer(texts)
    found = np.zeros(len(texts), dtype=bool)
    for first, last in pieces(bounds, 1 << 20):
        lower = _LOWER[flat[bounds[first] : bounds[last]]]
        letters = ((lower >= 0x61) & (lower <= 0x7A)).astype(np.int32)
        found[first:last] = row_sums(letters, bounds[first : last + 1] - bounds[first]) > 0
    for k in np.flatnonzero(~found):
        if texts[int(k)].is_valid:
            found[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    return found


def _trigrams(flat: np.ndarray, bounds: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of rows ``first`` to ``last``, and each row's bounds in them; none spans two rows."""
    data = _LOWER[flat[bounds[first] : bounds[last]]].astype(np.uint32)
    lengths = np.diff(bounds[first : last + 1])
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(last - first + 1, np.int64)
    code = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    code = (code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(7)) * np.uint32(0x85EBCA6B)
    bins = (code >> np.uint32(13)) & np.uint32(BINS - 1)
    inside = np.ones(len(data), dtype=bool)
    ends = np.cumsum(lengths)
    full = lengths > 0
    inside[ends[full] - 1] = False
    inside[np.maximum(ends[full] - 2, 0)] = False
    counts = np.maximum(lengths - 2, 0)
    return bins[inside[:-2]].astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def trigram_shares(texts: pa.Array) -> np.ndarray:
    """One row of ``BINS`` shares per text."""
    flat, bounds = text_buffer(texts)
    out = np.zeros((len(texts), BINS), np.float32)
    for first, last in pieces(bounds):
        bins, at = _trigrams(flat, bounds, first, last)
        for k in range(last - first):
            if at[k + 1] > at[k]:
                out[first + k] = np.bincount(bins[at[k] : at[k + 1]], minlength=BINS) * (SCALE / (at[k + 1] - at[k]))
    return out


def margins(texts: pa.Array, weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Margins of all classifiers (rows: texts) without building the vectors: mean weight of the text's trigrams."""
    flat, bounds = text_buffer(texts)
    out = np.tile(biases, (len(texts), 1))
    for first, last in pieces(bounds, 1 << 20):
        bins, at = _trigrams(flat, bounds, first, last)
        for k in range(weights.shape[1]):
            out[first:last, k] += row_sums(weights[:, k][bins], at) * SCALE / np.maximum(np.diff(at), 1)
    return out


class Rows:
    """Feature vectors as they came, in parts that are never copied into one."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([p @ v for p in self.parts])

    def summed(self, weights: np.ndarray) -> np.ndarray:
        """The vectors' weighed sum."""
        return np.sum([weights[a:b] @ p for p, a, b in zip(self.parts, self.bounds[:-1], self.bounds[1:], strict=True)], axis=0)


def fit_svm(x: Rows, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, classes weighed equally, bias not penalised) by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    wide = x.parts[0].shape[1]
    v = np.ones(wide + 1, np.float32)
    for _ in range(20):  # the largest curvature, by the power method
        v /= np.linalg.norm(v)
        r = share * (x.dot(v[:-1]) + v[-1])
        v = np.append(x.summed(r), r.sum())
    step = 1 / (2 * np.linalg.norm(v) * 1.05 + PENALTY)
    w = last = np.zeros(wide + 1, np.float32)
    for k in range(STEPS):
        ahead = w + (k / (k + 3)) * (w - last)
        slack = share * np.maximum(0, 1 - y * (x.dot(ahead[:-1]) + ahead[-1])) * y
        gradient = -2 * np.append(x.summed(slack), slack.sum())
        gradient[:-1] += PENALTY * ahead[:-1]
        last, w = w, (ahead - step * gradient).astype(np.float32)
    return w[:-1], float(w[-1])


def profile(x: Rows, trigrams: np.ndarray) -> np.ndarray:
    """For each bin the logarithm of how much likelier it is where half the trigrams are as in these rows than where all are even."""
    counts = x.summed(np.minimum(trigrams, PROFILE_TRIGRAMS) / SCALE) + PRIOR
    return np.log((1 + counts / counts.sum() * len(counts)) / 2)


class Classifier(NamedTuple):
    """Positive margins mean ``one``, negative ones ``other``; ``family`` is None for pairs of families."""

    family: str | None
    one: str
    other: str
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    """Families with their languages, a classifier for each pair of families and of languages of a family, and profiles if asked for."""

    families: dict[str, tuple[str, ...]]
    classifiers: tuple[Classifier, ...]
    #: For each language with rows to learn from: the logarithm each trigram adds to a text's likeness.
    profiles: dict[str, np.ndarray] = {}


@F.arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    known, parts = has_letters(texts), []
    for first in range(0, len(texts), 128):
        own = trigram_shares(texts[first : first + 128])
        parts.append(pa.array([row.tobytes() if ok else None for row, ok in zip(own, known[first : first + 128], strict=True)], pa.binary()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


_FITTED = pa.schema([("pair", pa.int32()), ("weights", pa.binary()), ("bias", pa.float64())])


def _fitter(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, signs, trigrams = [], [], []
    for batch in batches:
        parts.append(np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in batch.column("features")]))
        signs.append(batch.column("sign").to_numpy().astype(np.float32))
        trigrams.append(batch.column("trigrams").to_numpy())
    x, y = Rows(parts), np.concatenate(signs)
    weights, bias = fit_svm(x, y) if y.any() else (profile(x, np.concatenate(trigrams)), 0.0)
    del x, parts
    release()
    yield pa.RecordBatch.from_pydict({"pair": [key[0].as_py()], "weights": [weights.astype(np.float32).tobytes()], "bias": [bias]}, schema=_FITTED)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_class: int = PER_CLASS, families: Mapping[str, tuple[str, ...]] = FAMILIES, profiled: bool = False) -> Model:
    """A model from all rows given, of which about ``per_class`` a language are looked at; with profiles if ``profiled``."""
    named = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    place = family_of(families)
    # Thresholds, not ranks: whether a row is sampled is decided in the row.
    luck = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bar = F.lit(0.0)
    for lang, n in counts.items():
        bar = F.when(F.col("lang") == lang, F.lit(min(1.0, per_class / n))).otherwise(bar)
    sample = named.where(luck < bar).withColumn("features", _features("text")).where("features is not null").select("lang", "features", F.greatest(F.octet_length("text") - 2, F.lit(0)).alias("trigrams"))
    langs: dict[str, list[str]] = {}
    for lang in sorted(counts):
        langs.setdefault(place.get(lang, lang), []).append(lang)
    pairs = [(None, a, b, langs[a], langs[b]) for a, b in combinations(sorted(langs), 2)]
    pairs += [(family, a, b, [a], [b]) for family in sorted(langs) for a, b in combinations(langs[family], 2)]
    fitted: dict[int, tuple[np.ndarray, float]] = {}
    known = sorted(counts) if profiled else []
    if pairs or known:
        roles = [
            F.when(F.col("lang").isin(one), F.struct(F.lit(k).alias("pair"), F.lit(1).alias("sign"))).when(F.col("lang").isin(other), F.struct(F.lit(k).alias("pair"), F.lit(-1).alias("sign")))
            for k, (_, _, _, one, other) in enumerate(pairs)
        ]
        roles += [F.when(F.col("lang") == lang, F.struct(F.lit(len(pairs) + k).alias("pair"), F.lit(0).alias("sign"))) for k, lang in enumerate(known)]
        rows = sample.select("features", "trigrams", F.explode(F.array_compact(F.array(*roles))).alias("role")).select("features", "trigrams", "role.pair", "role.sign")
        trained = rows.groupBy("pair").applyInArrow(_fitter, "pair int, weights binary, bias double")
        fitted = {r[0]: (np.frombuffer(r[1], np.float32), r[2]) for r in trained.collect()}
    blank = np.zeros(BINS, np.float32), 0.0
    profiles = {lang: fitted[len(pairs) + k][0] for k, lang in enumerate(known) if len(pairs) + k in fitted}
    return Model({f: tuple(v) for f, v in langs.items()}, tuple(Classifier(f, a, b, *fitted.get(k, blank)) for k, (f, a, b, _, _) in enumerate(pairs)), profiles)


def _level(names: list[str], classifiers: list[tuple[int, Classifier]], margin: np.ndarray) -> np.ndarray:
    """Probabilities of the classes of one level (columns as ``names``): the mean vote of their pairs, made to add up to 1."""
    votes = np.zeros((len(margin), len(names)))
    if len(names) == 1:
        return votes + 1
    for k, c in classifiers:
        vote = 1 / (1 + np.exp(-STEEPNESS * margin[:, k]))
        votes[:, names.index(c.one)] += vote
        votes[:, names.index(c.other)] += 1 - vote
    return votes / votes.sum(axis=1, keepdims=True)


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    if not model.families:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    weights = np.stack([c.weights for c in model.classifiers], axis=1) if model.classifiers else np.zeros((BINS, 0), np.float32)
    margin = margins(texts, weights, np.array([c.bias for c in model.classifiers]))
    named = list(enumerate(model.classifiers))
    families = sorted(model.families)
    chances = _level(families, [(k, c) for k, c in named if c.family is None], margin)
    best = chances.argmax(axis=1)
    langs, score = np.empty(len(texts), dtype=object), chances.max(axis=1) if len(texts) else np.zeros(0)
    for f, family in enumerate(families):
        rows = np.flatnonzero(best == f)
        own = sorted(model.families[family])
        within = _level(own, [(k, c) for k, c in named if c.family == family], margin[rows])
        langs[rows] = [own[k] for k in within.argmax(axis=1)]
        score[rows] *= within.max(axis=1) if len(rows) else 1
    silent = ~has_letters(texts)
    langs[silent], score[silent] = UNKNOWN, 0.0
    return list(langs), np.clip(score, 0, 1)


def likeness(texts: pa.Array, langs: list[str], model: Model) -> np.ndarray:
    """How each text bears out the language it was given: a logarithm of odds, below 0 if even draws explain it better.

    A language without a profile (no row of it had letters) is neither borne out nor refuted: 0.
    """
    names = sorted(model.profiles)
    columns = {lang: k for k, lang in enumerate([*names, None])}
    weights = np.stack([*(model.profiles[lang] for lang in names), np.zeros(BINS, np.float32)], axis=1)
    mean = margins(texts, weights, np.zeros(len(columns)))
    own = mean[np.arange(len(texts)), [columns.get(lang, len(names)) for lang in langs]]
    return own / SCALE * np.maximum(np.diff(text_buffer(texts)[1]) - 2, 0)


def language_of(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column ``struct<lang_pred, score>`` for the rows of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(GUESS)
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            langs, score = predict(texts, shared.value)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], fields=list(_GUESS_ARROW))

    return guess(F.col(text_col).cast("string"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` (a null id: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fold: int = 0) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``; rows held out are not learned from."""
    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learned = slim.where(~held_out(id_col, folds, fold))
    if id_col != "doc_id":
        learned = learned.withColumnRenamed(id_col, "doc_id")
    model = fit(learned)
    return slim.withColumn("guess", language_of(slim, model)).select(id_col, held_out(id_col, folds, fold).alias("held_out"), "guess.lang_pred", "guess.score")


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text", odds: float = 0.05) -> Column:
    """Whether each text has a language, and bears it out with these odds at least; below 1, so that short texts get the benefit of the doubt."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            langs, _ = predict(texts, shared.value)
            spoken = np.array([lang != UNKNOWN for lang in langs], dtype=bool)
            yield pa.array(spoken & (likeness(texts, langs, shared.value) >= np.log(odds)), pa.bool_())

    return known(F.col(text_col).cast("string"))


def with_known_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", odds: float = 0.05, folds: int = 5, fold: int = 0) -> DataFrame:
    """``docs`` without the documents that are in no language: no letters, or odds below ``odds`` for the language they are most like."""
    own = free_name(docs, "known")
    model = fit(docs.where(~held_out(id_col, folds, fold)), text_col=text_col, lang_col=lang_col, id_col=id_col, profiled=True)
    return docs.withColumn(own, in_known_language(docs, model, text_col, odds)).where(F.col(own)).drop(own)
