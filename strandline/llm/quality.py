"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded; a gated
attention, learned from document labels alone, weighs the passages; the weighted mean of the
encodings is scored. A document of any length is read whole.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from strandline.llm.linear import sigmoid
from strandline.llm.samples import by_label, class_weights, held_out
from strandline.llm.words import LOWER, hashes, mix, slices, spans

PASSAGE = 48
#: Labelled rows for each label, width of encodings and of the attention, steps of training.
SAMPLE = 1200
WIDTH, GATES, STEPS = 24, 12, 150
THRESHOLD = 0.3

#: Class of each byte: letters, capitals, digits, each sign, blank, line end, control, beyond ASCII.
CLASS = np.full(256, 62, np.int64)
CLASS[97:123] = np.arange(26)
CLASS[65:91], CLASS[48:58] = 26, 27
CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = np.arange(28, 60)
CLASS[32], CLASS[10], CLASS[128:] = 60, 61, 63
CLASSES = 64
INPUTS = CLASSES + 6


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, a row for each passage; text number of each passage). Every text has one at least.

    Features: square roots of the shares of byte classes, mean word length, share of distinct
    words in the passage, share of words that the document has not had before, share of words
    that end in a sign, log of the number of words, share of long words.
    """
    out, owner = [], []
    for row, data, offsets in slices(texts):
        starts, ends, counts = spans(data, offsets)
        n = np.diff(counts)
        parts = np.maximum(1, -(-n // PASSAGE))
        first = np.cumsum(parts) - parts
        total = int(parts.sum())
        doc = np.repeat(np.arange(len(n)), parts)
        word_doc = np.repeat(np.arange(len(n)), n)
        at = first[word_doc] + (np.arange(len(starts)) - counts[:-1][word_doc]) // PASSAGE
        # a passage's bytes run from its first word to the next passage's
        edge = np.zeros(len(data) + 1, np.int64)
        begin = np.arange(len(starts)) == counts[:-1][word_doc] + (at - first[word_doc]) * PASSAGE
        later = begin & (at > first[word_doc])
        edge[starts[later]] = 1
        where = np.cumsum(edge[:-1])
        byte_doc = np.repeat(np.arange(len(n)), np.diff(offsets))
        base = np.cumsum(parts - 1) - (parts - 1)
        byte_at = first[byte_doc] + where - base[byte_doc]
        x = np.zeros((total, INPUTS))
        x[:, :CLASSES] = np.bincount(byte_at * CLASSES + CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES)
        x[:, :CLASSES] = np.sqrt(x[:, :CLASSES] / np.maximum(1, x[:, :CLASSES].sum(1, keepdims=True)))
        words = np.bincount(at, minlength=total)
        some = np.maximum(1, words)
        low = LOWER[data]
        h = hashes(low, starts, ends)
        size = ends - starts
        x[:, CLASSES] = np.bincount(at, weights=np.minimum(size, 40), minlength=total) / some / 10
        for k, key in ((1, at), (2, word_doc)):
            _, new = np.unique(mix(h + key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            x[:, CLASSES + k] = np.bincount(at[new], minlength=total) / some
        last = CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
        x[:, CLASSES + 3] = np.bincount(at, weights=(last >= 28) & (last < 60), minlength=total) / some
        x[:, CLASSES + 4] = np.log1p(words) / 4
        x[:, CLASSES + 5] = np.bincount(at, weights=size > 12, minlength=total) / some
        out.append(x)
        owner.append(doc + row)
    if not out:
        return np.zeros((0, INPUTS)), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


@dataclasses.dataclass
class Model:
    """Encoder, gated attention and scorer; ``mean`` and ``scale`` of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w, z = self.weights, (x - self.mean) / self.scale
        h = np.tanh(z @ w["encode"] + w["encode0"])
        t, g = np.tanh(h @ w["value"]), sigmoid(h @ w["gate"])
        a = (t * g) @ w["attend"]
        first = np.searchsorted(owner, np.arange(bags))
        e = np.exp(a - np.maximum.reduceat(a, first)[owner])
        a = e / np.add.reduceat(e, first)[owner]
        bag = np.add.reduceat(a[:, None] * h, first)
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "p": sigmoid(bag @ w["score"] + w["score0"])}

    def predict(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x, owner = passages(texts)
        return self.forward(x, owner, len(texts))["p"]


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Full-batch Adam on the weighted log loss of the documents' labels."""
    r = np.random.default_rng(seed)
    shapes = {"encode": (INPUTS, WIDTH), "encode0": (WIDTH,), "value": (WIDTH, GATES), "gate": (WIDTH, GATES), "attend": (GATES,), "score": (WIDTH,), "score0": ()}
    w = {k: r.normal(size=s) * (s[0] ** -0.5 if s else 0.0) for k, s in shapes.items()}
    w["encode0"] *= 0
    share = (float(weight @ y) + 0.5) / (float(weight.sum()) + 1.0) if len(y) else 0.5
    w["score0"] = np.array(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        w["score"] *= 0
        return Model(np.zeros(INPUTS), np.ones(INPUTS), w)
    x, owner = passages(texts)
    model = Model(x.mean(0), x.std(0) + 0.02, w)
    weight = weight / weight.sum()
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, owner, len(y))
        up = weight * (f["p"] - y)
        d_bag = up[:, None] * w["score"]
        d_h = f["a"][:, None] * d_bag[owner]
        d_a = (f["h"] * d_bag[owner]).sum(1)
        d_a = f["a"] * (d_a - np.bincount(owner, f["a"] * d_a, minlength=len(y))[owner])
        d_tg = d_a[:, None] * w["attend"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h += d_t @ w["value"].T + d_g @ w["gate"].T
        d_z = d_h * (1 - f["h"] ** 2)
        slope = {
            "score": f["bag"].T @ up, "score0": np.array(up.sum()), "attend": (f["t"] * f["g"]).T @ d_a, "value": f["h"].T @ d_t,
            "gate": f["h"].T @ d_g, "encode": f["z"].T @ d_z, "encode0": d_z.sum(0),
        }
        for k, g in slope.items():
            g = g + 1e-4 * w[k] * (k != "score0")
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fitted(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Learned from about ``rows`` labelled documents of each label that are not held out."""
    got = by_label(documents, labels, ["quality"], rows)
    y = np.array(got.column("quality").to_pylist(), float)
    return train(got.column("text").combine_chunks(), y, np.array(class_weights(got, labels, ["quality"]), float))


def predictor(model: Model):
    """Column function: text to the probability of quality 1."""
    return F.arrow_udf(lambda texts: pa.array(model.predict(texts), pa.float64()), DoubleType())


def score(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``.

    A null or empty text is one passage without words and has its score. Without labelled rows
    every score is one half; with one label only it is near that label. Null and repeated
    doc_ids are rows of their own; a null doc_id counts as held out.
    """
    p = predictor(fitted(documents, labels, rows))(F.col("text").cast("string"))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), p.alias("score"))
    return d.select("doc_id", "held_out", "score", F.expr(f"cast(score >= {threshold} as int)").alias("predicted"))
