"""State of a streamed fold: waiting rows in buckets of time, the learner on its own.

A row waits until the watermark has passed it.  Rows of a key are appended in chunks under
(bucket of time, chunk), so a new batch never touches those already there, and a timer at the
earliest waiting row takes the buckets that are due one after another: what is in memory at once
is one bucket, whatever the key's backlog.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Results from which on a frame is handed over: one for every bucket would cost more than the fold.
FRAME = 10_000


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One column from several chunks, without turning whole numbers of one into doubles of another."""
    return np.concatenate(parts if len({p.dtype for p in parts}) == 1 else [p.astype(object) for p in parts])


def _ranks(column: np.ndarray) -> np.ndarray:
    """Ranks of the values, nulls last."""
    codes = pd.factorize(column, sort=True)[0]
    return np.where(codes < 0, len(codes), codes)


class FoldProcessor(StatefulProcessor):
    """Folds the rows of a key in time order with ``make(key).row(*inputs)``.

    A step that has ``rows(*columns)`` gets a bucket's rows as arrays instead and returns the
    places of those that give a result, and the results' columns.  ``columns`` are the waiting
    row's columns, time first; ``tie`` the places that order rows of one time.  State: ``rows``
    maps (bucket, chunk) to the arrays of a chunk, times in microseconds, ``index`` holds for each
    bucket its number of chunks and earliest time, ``step`` the learner.
    """

    def __init__(self, make: Callable[[dict], object], keys: Sequence[str], columns: Sequence[str], inputs: Sequence[int], keep: Sequence[int], tie: Sequence[int], names: Sequence[str], bucket_ms: int):
        self.make, self.keys, self.columns = make, list(keys), list(columns)
        self.inputs, self.keep, self.tie, self.names = list(inputs), list(keep), list(tie), list(names)
        self.width = bucket_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "bucket bigint, chunk int", "rows binary")
        self.index = handle.getValueState("index", "buckets binary")
        self.step = handle.getValueState("step", "step binary")

    def _buckets(self) -> dict[int, tuple[int, int]]:
        """Bucket to (chunks, earliest time)."""
        return pickle.loads(self.index.get()[0]) if self.index.exists() else {}

    def _wake(self, buckets: dict[int, tuple[int, int]]) -> None:
        """A timer at the earliest waiting row, in whole milliseconds not before it."""
        if buckets:
            first = min(earliest for _, earliest in buckets.values())
            self.handle.registerTimer(-(-first // 1000))

    def _append(self, buckets: dict, bucket: int, waiting: list[np.ndarray]) -> None:
        earliest = int(waiting[0].min())
        chunks, before = buckets.get(bucket, (0, earliest))
        self.rows.updateValue((bucket, chunks), (pickle.dumps(waiting),))
        buckets[bucket] = (chunks + 1, min(before, earliest))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buckets = self._buckets()
        for pdf in rows:
            if not len(pdf):
                continue
            columns = [pdf[c].to_numpy() for c in self.columns]
            columns[0] = columns[0].astype("datetime64[us]").astype(np.int64)
            bucket = columns[0] // self.width
            order = np.argsort(bucket, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                self._append(buckets, int(bucket[some[0]]), [c[some] for c in columns])
        self.index.update((pickle.dumps(buckets),))
        self._wake(buckets)
        return iter([])

    def _due(self, buckets: dict, bucket: int, horizon: int) -> list[np.ndarray]:
        """Rows of the bucket up to the horizon, in order; later ones go back as one chunk."""
        chunks, _ = buckets.pop(bucket)
        parts = []
        for c in range(chunks):
            parts.append(pickle.loads(self.rows.getValue((bucket, c))[0]))
            self.rows.removeKey((bucket, c))
        waiting = [_joined(list(column)) for column in zip(*parts, strict=True)]
        later = waiting[0] > horizon
        if later.any():
            self._append(buckets, bucket, [c[later] for c in waiting])
            waiting = [c[~later] for c in waiting]
        order = np.argsort(waiting[0], kind="stable")
        if (np.diff(waiting[0][order]) == 0).any():
            order = np.lexsort([*[_ranks(waiting[i]) for i in self.tie[::-1]], waiting[0]])
        return [c[order] for c in waiting]

    def _folded(self, step: object, columns: list[np.ndarray]) -> tuple[Sequence[int], list]:
        """Places of the rows that give a result, and the results' columns."""
        many = getattr(step, "rows", None)
        if many is not None:
            return many(*columns)
        at, made = [], []
        for i, values in enumerate(zip(*[pd.Series(c).tolist() for c in columns], strict=True)):
            result = step.row(*values)
            if result is not None:
                at.append(i)
                made.append(result)
        return at, [pd.Series(c).to_numpy() for c in zip(*made, strict=True)]

    def _frame(self, key, parts: list[list[np.ndarray]]) -> pd.DataFrame:
        """Results of several buckets: keys, time, kept columns, outputs."""
        times, *columns = (_joined(list(column)) for column in zip(*parts, strict=True))
        out = dict(zip(self.keys, key, strict=True)) | {"ts": times.astype("datetime64[us]")}
        return pd.DataFrame(out | dict(zip([*[self.columns[i] for i in self.keep], *self.names], columns, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        buckets = self._buckets()
        due = sorted(b for b, (_, earliest) in buckets.items() if earliest <= horizon)
        if not due:
            return
        step = pickle.loads(self.step.get()[0]) if self.step.exists() else self.make(dict(zip(self.keys, key, strict=True)))
        parts, size = [], 0
        for bucket in due:
            waiting = self._due(buckets, bucket, horizon)
            at, made = self._folded(step, [waiting[i] for i in self.inputs])
            if len(at):
                parts.append([waiting[0][at], *[waiting[i][at] for i in self.keep], *made])
                size += len(at)
            if size >= FRAME:
                yield self._frame(key, parts)
                parts, size = [], 0
        if parts:
            yield self._frame(key, parts)
        self.step.update((pickle.dumps(step),))
        self.index.update((pickle.dumps(buckets),))
        self._wake(buckets)

    def close(self) -> None:
        pass
