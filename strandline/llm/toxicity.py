"""Toxicity by a classifier chain: each category's model also sees the earlier categories.

Features are the words, word beginnings and runs of signs that a document holds. For each
category those that tell its documents apart are selected on the sample, and a logistic model
is fitted to them and to the log odds of the earlier categories. While the chain is trained,
those odds come from models of other folds, so a later model meets them as it will for new
documents; at the end every model is fitted to the whole sample.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.llm.linear import fit, sigmoid
from strandline.llm.samples import by_label, class_weights, held_out
from strandline.llm.words import LOWER, give_back, hashes, mix, slices, spans

#: Labelled rows for each combination of labels, folds, and most features of a category.
SAMPLE = 1200
FOLDS = 4
FEATURES = 600
#: Least likelihood ratio statistic of a feature (one degree of freedom), and least documents.
SIGNIFICANT = 20.0
DOCUMENTS = 5
#: Bytes of a word's beginnings that are features as well.
BEGINNINGS = (4, 5)
THRESHOLD = 0.5

NOT_LETTER = np.ones(256, bool)
NOT_LETTER[97:123] = NOT_LETTER[128:] = False
NOT_SIGN = np.ones(256, bool)
NOT_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = False


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, 64-bit features, text of each feature counted from the first row)."""
    for row, data, offsets in slices(texts):
        data = LOWER[data]
        found, owner = [], []
        starts, ends, counts = spans(data, offsets, NOT_LETTER)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
        found.append(hashes(data, starts, ends))
        owner.append(doc)
        for k in BEGINNINGS:
            long = ends - starts > k
            found.append(mix(hashes(data, starts[long], starts[long] + k) + np.uint64(k)))
            owner.append(doc[long])
        starts, ends, counts = spans(data, offsets, NOT_SIGN)
        found.append(hashes(data, starts, ends))
        owner.append(np.repeat(np.arange(len(offsets) - 1), np.diff(counts)))
        yield row, np.concatenate(found), np.concatenate(owner)


def held(texts: pa.Array, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, text counted from it, place in the sorted features ``known``), each pair once."""
    if not len(known):
        return
    may = np.zeros(1 << 20, bool)
    may[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    for row, found, owner in features(texts):
        keep = may[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]
        found, owner = found[keep], owner[keep]
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[at] == found
        pairs = np.unique(owner[hit] * len(known) + at[hit])
        yield row, pairs // len(known), pairs % len(known)


def presence(texts: pa.Array, known: np.ndarray) -> np.ndarray:
    """Which of the sorted features ``known`` each text holds (0 or 1), a row for each text; for few texts."""
    out = np.zeros((len(texts), len(known)), np.float32)
    for row, doc, at in held(texts, known):
        out[row + doc, at] = 1.0
    return out


def selected(which: np.ndarray, owner: np.ndarray, y: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The features that say most about the label among ``rows``, by the likelihood ratio statistic.

    A rare feature that only labelled documents hold ranks high, as it should.

    ``which`` and ``owner`` are the distinct (feature number, document) pairs of the sample;
    the numbers of the chosen features come back in order.
    """
    with_ = np.bincount(which, weights=(y * rows)[owner], minlength=size)
    without = np.bincount(which, weights=((1 - y) * rows)[owner], minlength=size)
    p, n = float((y * rows).sum()), float(((1 - y) * rows).sum())
    total = np.maximum(p + n, 1.0)
    gain = np.zeros(size)
    for seen, of in ((with_, p), (without, n), (p - with_, p), (n - without, n)):
        held = with_ + without if seen is with_ or seen is without else total - with_ - without
        even = held * of / total
        gain += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(even, 1e-9))
    gain[with_ + without < DOCUMENTS] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    return np.sort(best[gain[best] >= SIGNIFICANT])


@dataclasses.dataclass
class Chain:
    """For each category in order: its features, weights (the earlier log odds last) and bias."""

    names: list[str]
    known: list[np.ndarray]
    weights: list[np.ndarray]
    bias: list[float]

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Probabilities, a column for each category."""
        every = np.unique(np.concatenate([*self.known, np.zeros(0, np.uint64)]))
        tables = np.zeros((len(self.names), len(every)))
        for table, known, w in zip(tables, self.known, self.weights, strict=True):
            table[np.searchsorted(every, known)] = w[: len(known)]
        odds = np.tile(np.array(self.bias, float), (len(texts), 1))
        # added up run by run: no table of texts and features
        for row, doc, at in held(texts, every):
            last = int(doc[-1]) + 1 if len(doc) else 0
            for k, table in enumerate(tables):
                odds[row : row + last, k] += np.bincount(doc, weights=table[at], minlength=last)
        for k, (known, w) in enumerate(zip(self.known, self.weights, strict=True)):
            odds[:, k] += odds[:, :k] @ w[len(known) :]
        return sigmoid(odds)


def train(texts: pa.Array, labels: np.ndarray, names: list[str], weight: np.ndarray) -> Chain:
    """The chain over the columns of ``labels`` in order."""
    pairs, owner = [], []
    for row, found, doc in features(texts):
        order = np.lexsort((doc, found))
        f, d = found[order], doc[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
        pairs.append(f[new])
        owner.append(d[new] + row)
    pairs, owner = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((pairs, np.uint64), (owner, np.int64)))
    every, which = np.unique(pairs, return_inverse=True)

    def beside(known: np.ndarray, odds: np.ndarray) -> np.ndarray:
        column = np.full(len(every), -1)
        column[known] = np.arange(len(known))
        hit = column[which] >= 0
        x = np.zeros((len(texts), len(known) + odds.shape[1]), np.float32)
        x[owner[hit], column[which[hit]]] = 1.0
        x[:, len(known) :] = odds
        return x

    fold = np.arange(len(texts)) % FOLDS
    odds, chain = np.zeros((len(texts), 0)), Chain(list(names), [], [], [])
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        own = np.zeros(len(y))
        for out in range(FOLDS):
            rows = fold != out
            x = beside(selected(which, owner, y, rows, len(every)), odds)
            w, b = fit(x[rows], y[rows], "logistic", l2=2e-3, rounds=150, weight=weight[rows])
            own[~rows] = (x @ w + b)[~rows]
        known = selected(which, owner, y, np.ones(len(y), bool), len(every))
        w, b = fit(beside(known, odds), y, "logistic", l2=2e-3, rounds=150, weight=weight)
        chain.known.append(every[known])
        chain.weights.append(w)
        chain.bias.append(b)
        odds = np.concatenate((odds, own[:, None]), 1)
    return chain


def fitted(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Chain:
    """The chain low quality, then toxic, learned from labelled documents that are not held out."""
    got = by_label(documents, labels, ["quality", "toxic"], rows)
    y = np.stack([1 - np.array(got.column("quality").to_pylist() or [], int), np.array(got.column("toxic").to_pylist() or [], int)], 1)
    weight = np.array(class_weights(got, labels, ["quality", "toxic"]) or [], float)
    chain = train(got.column("text").combine_chunks(), y, ["low_quality", "toxic"], weight)
    del got
    give_back()
    return chain


def predictor(chain: Chain):
    """Column function: text to the probability of each category."""

    def predict(texts: pa.Array) -> pa.Array:
        p = chain.predict(texts)
        give_back()
        return pa.StructArray.from_arrays([pa.array(p[:, k], pa.float64()) for k in range(len(chain.names))], names=chain.names)

    return F.arrow_udf(predict, StructType([StructField(n, DoubleType()) for n in chain.names]))


def score(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, low_quality, toxic, predicted) of every row of ``documents``.

    ``low_quality`` and ``toxic`` are probabilities, ``predicted`` is 1 where toxic reaches
    ``threshold``. Null and empty texts have no features: they get the chain's base rates.
    Without labelled rows every probability is one half or follows from the labels that
    exist. Null and repeated doc_ids are rows of their own; a null doc_id counts as held out.
    """
    p = predictor(fitted(documents, labels, rows))(F.col("text").cast("string"))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), p.alias("p"))
    return d.select("doc_id", "held_out", "p.low_quality", "p.toxic", F.expr(f"cast(p.toxic >= {threshold} as int)").alias("predicted"))
