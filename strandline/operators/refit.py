"""A sign classifier refitted as the series grows: each net starts from the weights of the one before."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from strandline.operators.fold import ordered_fold

SEED = 17


class SignNet:
    """Layers of tanh units with one output in (-1, 1), trained on squared errors of all rows at once."""

    def __init__(self, features: int, hidden: Sequence[int], seed: int = SEED):
        sizes = [features, *hidden, 1]
        rng = np.random.default_rng(seed)
        self.layers = [(rng.normal(size=(a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """The rows and every layer's answer to them."""
        seen = [x]
        for w, b in self.layers:
            seen.append(np.tanh(seen[-1] @ w + b))
        return seen

    def slopes(self, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Gradient of half the mean squared error, layer by layer."""
        seen = self.outputs(x)
        back = (seen[-1] - y[:, None]) * (1.0 - seen[-1] ** 2) / len(y)
        found = []
        for (w, _), low in zip(self.layers[::-1], seen[-2::-1]):
            found.append((low.T @ back, back.sum(axis=0)))
            back = (back @ w.T) * (1.0 - low**2)
        return found[::-1]

    def train(self, x: np.ndarray, y: np.ndarray, passes: int, rate: float, inertia: float = 0.9) -> None:
        speed = [(np.zeros_like(w), np.zeros_like(b)) for w, b in self.layers]
        for _ in range(passes):
            speed = [(inertia * vw - rate * gw, inertia * vb - rate * gb) for (vw, vb), (gw, gb) in zip(speed, self.slopes(x, y))]
            self.layers = [(w + vw, b + vb) for (w, b), (vw, vb) in zip(self.layers, speed)]


class RefitStep:
    """All complete rows so far, the present net and the scale of the rows that it was fitted on."""

    def __init__(self, features: int, first: int, every: int, hidden: Sequence[int], passes: int, rate: float):
        self.first, self.every, self.passes, self.rate = first, every, passes, rate
        self.net = SignNet(features, hidden)
        self.n, self.refits, self.trained, self.total = 0, 0, 0, 0.0
        self.x, self.y = np.empty((256, features)), np.empty(256)

    def row(self, x: Sequence[float], value: float) -> tuple | None:
        x = np.asarray(x, dtype=float)
        if value != value or not np.isfinite(x).all():
            return None
        out = None
        if self.n >= self.first:
            if (self.n - self.first) % self.every == 0:
                self._refit()
            answer = float(self.net.outputs(((x - self.mean) / self.scale)[None, :])[-1][0, 0])
            base = self.total / self.n
            out = (float(np.sign(value)), answer, base, -1.0 if answer < base else 1.0, self.refits, self.trained)
        if self.n == len(self.y):
            self.x, self.y = np.concatenate([self.x, np.empty_like(self.x)]), np.concatenate([self.y, np.empty_like(self.y)])
        self.x[self.n], self.y[self.n] = x, np.sign(value)
        self.total += self.y[self.n]
        self.n += 1
        return out

    def _refit(self) -> None:
        x, y = self.x[: self.n], self.y[: self.n]
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(sd > 1e-12 * np.abs(self.mean), sd, np.inf)  # a constant feature says nothing
        self.net.train((x - self.mean) / self.scale, y, self.passes, self.rate)
        self.refits, self.trained = self.refits + 1, self.n


def expanding_sign_network(df: DataFrame, value: str, features: Sequence[str], first: int = 126, every: int = 126, hidden: Sequence[int] = (8, 4), passes: int = 400, rate: float = 0.05, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Sign of ``value`` from features known before it, by a net refitted every ``every`` rows on all rows before.

    Columns: keys, ts, ``value``, label (its sign), answer (of the net), base (mean sign of all
    earlier rows), signal (1, or -1 where the answer lies below the base), refits so far and
    trained, the rows the present net saw.  Rows with a null or non-finite number are left out; the first
    ``first`` complete ones only train.  A refit goes on from the weights before; features are
    scaled by the rows that it sees.  State is one row of doubles for each past bar of a key.
    """
    if first < 2 or min(every, passes, *hidden) < 1 or not features:
        raise ValueError("needs first of 2 or more, every, passes and layers of 1 or more, and a feature")
    p = len(features)
    rows = df.dropna(subset=[value, *features]).select(*keys, "ts", F.col(value).cast("double").alias(value), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    outputs = "label double, answer double, base double, signal double, refits int, trained bigint"
    return ordered_fold(rows, lambda key: RefitStep(p, first, every, hidden, passes, rate), ["_x", value], outputs, keys=keys, keep=[value])
