"""Ordered folds: recursions whose next state depends on their own last output.

Rows are hash-partitioned by key, sorted on disk by (key, time) and streamed
through Arrow batches; the state of the current key is all that stays in memory,
whatever the key's length.  Work is parallel over series x parameters x folds,
which is why parameters are key columns.  A recursion cannot be split over time;
feed it calendar bars, not ticks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[..., tuple]


def _runs(keys: pd.DataFrame) -> list[tuple[int, int]]:
    """Half-open index ranges of equal consecutive keys."""
    if len(keys) == 0:
        return []
    change = (keys != keys.shift()).any(axis=1).to_numpy()
    change[0] = True
    starts = change.nonzero()[0].tolist()
    return list(zip(starts, [*starts[1:], len(keys)]))


def ordered_fold(df: DataFrame, make: Callable[[dict], object], inputs: Sequence[str], outputs: str, keys: Sequence[str] = ("series_id",), order: str = "ts", keep: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Run ``make(key).row(*inputs) -> tuple`` over every key in time order.

    ``outputs`` is a DDL list of the tuple's columns; a row whose step returns
    None is not emitted.  Rows of one time follow the ``tie`` columns.  Result columns:
    keys, order, ``keep``, outputs.
    """
    cols = list(dict.fromkeys([*keys, order, *inputs, *keep, *tie]))
    src = df.select(*cols).repartition(*keys).sortWithinPartitions(*keys, order, *tie)
    kept = [*keys, order, *[k for k in keep if k not in keys]]
    fields = src.schema
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in kept) + ", " + outputs
    names = [part.strip().split(" ")[0].strip("`") for part in outputs.split(",")]
    keys, inputs = list(keys), list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for pdf in batches:
            columns = [pdf[c].to_numpy(dtype=object).tolist() if pdf[c].dtype == object else pdf[c].tolist() for c in inputs]
            out: list[tuple] = []
            index: list[int] = []
            for a, b in _runs(pdf[keys]):
                key = tuple(pdf[k].iat[a] for k in keys)
                if key != current:
                    current, step = key, make(dict(zip(keys, key)))
                row = step.row
                for i in range(a, b):
                    result = row(*[c[i] for c in columns])
                    if result is not None:
                        out.append(result)
                        index.append(i)
            if out:
                made = pdf[kept].iloc[index].reset_index(drop=True)
                yield made.assign(**pd.DataFrame(out, columns=names))

    return src.mapInPandas(run, schema)


class _Episode:
    """One part of one fold: a fresh step and the running score of its returns."""

    def __init__(self, fold: int, part: str, end: int, step: object):
        self.fold, self.part, self.end, self.step = fold, part, end, step
        self.n, self.sum, self.squares, self.growth = 0, 0.0, 0.0, 1.0

    def row(self, values: list) -> None:
        r = self.step.row(*values)
        if r is not None:
            self.n += 1
            self.sum += r
            self.squares += r * r
            self.growth *= 1.0 + r

    def score(self) -> tuple:
        if self.n == 0:
            return (self.fold, self.part, 0, None, None)
        mean = self.sum / self.n
        var = self.squares / self.n - mean * mean
        # a variance within rounding of zero is that of constant returns
        flat = var <= 1e-12 * self.squares / self.n
        return (self.fold, self.part, self.n, self.growth - 1.0, None if flat else mean / var**0.5)


def fold_episodes(df: DataFrame, make: Callable[[dict], object], inputs: Sequence[str], train: int, test: int, step: int, keys: Sequence[str] = ("series_id",), order: str = "ts") -> DataFrame:
    """Scores of a stateful strategy that starts anew at the first row of every fold's parts.

    ``make(key).row(*inputs)`` gives the return of one row (None: not counted).  Training parts
    begin every ``step`` rows; the test part follows with a state of its own, so nothing held at
    the end of training is carried over.  All parts of a key are run in one sorted pass: a row
    goes to the (train + test) / step folds that cover it, and one row a finished part comes out:
    keys, fold, part, rows, total_return, sharpe.  Parts that the series does not complete give
    no row.
    """
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be positive")
    keys, inputs = list(keys), list(inputs)
    src = df.select(*dict.fromkeys([*keys, order, *inputs])).repartition(*keys).sortWithinPartitions(*keys, order)
    fields = src.schema
    names = ["fold", "part", "rows", "total_return", "sharpe"]
    schema = ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys) + ", fold int, part string, rows bigint, total_return double, sharpe double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, t, active = None, 0, []
        for pdf in batches:
            columns = [pdf[c].to_numpy(dtype=object).tolist() if pdf[c].dtype == object else pdf[c].tolist() for c in inputs]
            out = []
            for a, b in _runs(pdf[keys]):
                key = tuple(pdf[k].iat[a] for k in keys)
                if key != current:
                    current, t, active = key, 0, []
                named = dict(zip(keys, key))
                for i in range(a, b):
                    if t % step == 0:
                        active.append(_Episode(t // step, "train", t + train, make(named)))
                    if t >= train and (t - train) % step == 0:
                        active.append(_Episode((t - train) // step, "test", t + test, make(named)))
                    values = [c[i] for c in columns]
                    t += 1
                    ended = False
                    for e in active:
                        e.row(values)
                        if e.end == t:
                            out.append((*key, *e.score()))
                            ended = True
                    if ended:
                        active = [e for e in active if e.end > t]
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names])

    return src.mapInPandas(run, schema)


def recent(history: list, n: int) -> list:
    """Keep the last n items of a growing list in place."""
    if len(history) > n:
        del history[: len(history) - n]
    return history
