"""Language identification in two levels: the family first, then its languages.

The family is the best of one-versus-rest linear support vector machines; within it, one
machine for each pair of languages separates the closely related ones. Features are relative
frequencies of hashed byte pairs and triples of the lower-cased letters of the whole text, so
a margin is a mean of weights over the text and long texts cost one pass.
"""

from __future__ import annotations

import dataclasses
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strandline.llm.linear import calibrated, fit, sigmoid
from strandline.llm.samples import held_out
from strandline.llm.words import give_back, slices

#: Labelled rows of each language that the models are fitted on: a bound, not a share.
SAMPLE = 250
PAIRS, TRIPLES = 4096, 8192
SIZE = PAIRS + TRIPLES
UNKNOWN = "und"

# fixed values: families of languages by code
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the pair and the triple at each byte; SIZE where there is none."""
    b = LETTER[data]
    capital = np.zeros(len(b), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    b[capital] += 32  # accented capitals of the first Latin block
    b = np.concatenate((b, [32, 32])).astype(np.uint32)
    two = b[:-2] << 8 | b[1:-1]
    three = two << 8 | b[2:]
    letter = b != 32
    pair = (two * np.uint32(2654435761) >> np.uint32(20)).astype(np.int32)
    triple = (three * np.uint32(2246822519) >> np.uint32(19)).astype(np.int32) + PAIRS
    pair[~(letter[:-2] | letter[1:-1])] = SIZE
    triple[~(letter[:-2] | letter[1:-1] | letter[2:])] = SIZE
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    pair[ends] = SIZE
    triple[ends] = SIZE
    triple[np.maximum(ends - 1, 0)] = SIZE
    return pair, triple


def features(texts: pa.Array) -> np.ndarray:
    """Relative frequencies, a row for each text; for the bounded sample only."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for row, data, offsets in slices(texts):
        pair, triple = _grams(data, offsets)
        for k in range(len(offsets) - 1):
            a, b = offsets[k], offsets[k + 1]
            for g in (pair[a:b], triple[a:b]):
                g = g[g < SIZE]
                out[row + k] += np.bincount(g, minlength=SIZE) / np.float32(max(1, len(g)))
    return out


def margins(texts: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Margin of each text under each column of ``weights``, and whether it has no features."""
    table = np.concatenate((weights, np.zeros((1, weights.shape[1])))).astype(np.float32)
    out = np.tile(bias, (len(texts), 1)).astype(np.float64)
    for row, data, offsets in slices(texts):
        some = np.flatnonzero(np.diff(offsets) > 0)
        if not len(some):
            continue
        for g in _grams(data, offsets):
            n = np.add.reduceat((g < SIZE).astype(np.int64), offsets[some])
            for k in range(weights.shape[1]):
                total = np.add.reduceat(table[:, k][g].astype(np.float64), offsets[some])
                out[row + some, k] += total / np.maximum(n, 1)
    return out


@dataclasses.dataclass
class Model:
    """Machines (columns of weights) of both levels with the calibration of their margins."""

    families: list[str]
    languages: dict[str, list[str]]
    columns: dict[tuple[str, str], int]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    offset: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text; ``und`` and 0 without a letter or a model."""
        p = sigmoid(margins(texts, self.weights, self.bias) * self.slope + self.offset)
        out, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        letters = np.fromiter((any(map(str.isalpha, t.as_py() or "")) for t in texts), bool, len(texts))
        if not self.families or not len(texts):
            return list(out), score
        chance = np.stack([p[:, self.columns[f, ""]] if (f, "") in self.columns else np.ones(len(p)) for f in self.families], 1) + 1e-12
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        for k, f in enumerate(self.families):
            rows, codes = np.flatnonzero(letters & (best == k)), self.languages[f]
            wins = np.ones((len(rows), len(codes)))
            for i, j in itertools.combinations(range(len(codes)), 2):
                q = p[rows, self.columns[codes[i], codes[j]]]
                wins[:, i] *= q
                wins[:, j] *= 1 - q
            wins = (wins + 1e-12) / (wins + 1e-12).sum(1, keepdims=True)
            out[rows] = np.array(codes, object)[wins.argmax(1)]
            score[rows] = chance[rows, k] * wins.max(1)
        return list(out), score


def train(texts: pa.Array, langs: list[str]) -> Model:
    """Machines for the families and, within each, for the pairs of languages."""
    x, lang = features(texts), np.array(langs, object)
    codes = sorted(set(langs))
    languages: dict[str, list[str]] = {}
    for c in codes:
        languages.setdefault(FAMILY_OF.get(c, c), []).append(c)
    family = np.array([FAMILY_OF.get(c, c) for c in langs], object)
    families = sorted(languages)
    tasks = [((f, ""), np.ones(len(x), bool), family == f) for f in families] if len(families) > 1 else []
    for f in families:
        tasks += [((a, b), (lang == a) | (lang == b), lang == a) for a, b in itertools.combinations(languages[f], 2)]
    weights, bias, slope, offset = np.zeros((SIZE, len(tasks))), np.zeros(len(tasks)), np.ones(len(tasks)), np.zeros(len(tasks))
    for k, (_, rows, y) in enumerate(tasks):
        z, y = x if rows.all() else x[rows], y[rows].astype(float)
        share = np.clip(y.mean(), 0.01, 0.99)
        weights[:, k], bias[k] = fit(z, y, "hinge", l2=1e-2, rounds=120, weight=np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))
        slope[k], offset[k] = calibrated(z @ weights[:, k] + bias[k], y)
    return Model(families, languages, {name: k for k, (name, _, _) in enumerate(tasks)}, weights, bias, slope, offset)


def labelled_sample(documents: DataFrame, rows: int = SAMPLE) -> tuple[pa.Array, list[str]]:
    """About ``rows`` labelled texts of each language (all, if fewer), chosen by hash."""
    d = documents.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", "cast(lang as string) as lang")
    d = d.where(~held_out()).where("text is not null and lang is not null")
    counts = d.groupBy("lang").agg(F.count("*").alias("n"))
    # a row for each language: small enough to send to every task, so no text is shuffled
    chosen = d.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(rows * (1 << 30)) / F.col("n"))
    got = chosen.select("lang", "text").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    return got.column("text").combine_chunks().cast(pa.large_string()), got.column("lang").to_pylist()


ANSWER = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predictor(model: Model):
    """Column function: text to (lang, score)."""

    def predict(texts: pa.Array) -> pa.Array:
        lang, score = model.predict(texts)
        give_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    return F.arrow_udf(predict, ANSWER)


def fitted(documents: DataFrame, rows: int = SAMPLE) -> Model:
    model = train(*labelled_sample(documents, rows))
    give_back()
    return model


def identify(documents: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``documents``.

    Learned from rows with text and lang that are not held out. A null text and a text without
    any letter is ``und`` with score 0, as is every text if no row is labelled. Null and
    repeated doc_ids are rows of their own; a null doc_id counts as held out.
    """
    answer = predictor(fitted(documents, rows))(F.col("text").cast("string"))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), answer.alias("answer"))
    return d.select("doc_id", "held_out", F.col("answer.lang").alias("lang_pred"), F.col("answer.score").alias("score"))
