"""Order statistics of a growing collection: values in sorted blocks with their counts.

A new value goes into one block, found by the blocks' largest values; a rank is found by adding
up block sizes.  Neither touches more than one block and one number a block, so a step costs
about the square root of what has been seen, and a whole series never has to be sorted again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame

from strandline.frames import KEYS
from strandline.operators.fold import ordered_fold

#: A block is cut in two when it holds this many values.
FULL = 1024


class SortedBlocks:
    def __init__(self):
        self.blocks: list[list[float]] = []
        self.largest: list[float] = []
        self.n = 0

    def add(self, x: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks, self.largest = [[x]], [x]
            return
        k = min(bisect_left(self.largest, x), len(self.blocks) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.largest[k] = block[-1]
        if len(block) >= FULL:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.largest[k : k + 1] = [block[half - 1], block[-1]]

    def pair(self, rank: int) -> tuple[float, float]:
        """The values of ``rank`` (from 0) and the next rank; the last value has itself as next."""
        for k, block in enumerate(self.blocks):
            if rank < len(block):
                if rank + 1 < len(block):
                    return block[rank], block[rank + 1]
                after = self.blocks[k + 1][0] if k + 1 < len(self.blocks) else block[rank]
                return block[rank], after
            rank -= len(block)
        raise IndexError(rank)

    def quantile(self, q: float) -> float | None:
        """Linear between the two nearest ranks; None while there is no value."""
        if not self.n:
            return None
        at = q * (self.n - 1)
        low, high = self.pair(int(at))
        part = at - int(at)
        return low if part == 0.0 else (1.0 - part) * low + part * high


class Quantiles:
    """Quantiles of several columns over all rows so far; a missing value is not counted."""

    def __init__(self, columns: int, q: float):
        self.q, self.seen = q, [SortedBlocks() for _ in range(columns)]

    def row(self, *values):
        for blocks, x in zip(self.seen, values, strict=True):
            if x is not None and x == x:
                blocks.add(float(x))
        return tuple(blocks.quantile(self.q) for blocks in self.seen)


def expanding_quantiles(df: DataFrame, columns: dict[str, str], q: float, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Add the quantile of all rows up to the current one for each column: name of the column to name of the result.

    All columns are handled in one sorted pass.  The state of a key holds its past values, one
    double each, so feed it bars; ``quantiles.exact_quantiles`` gives one quantile of any number
    of ticks.
    """
    out = ", ".join(f"`{name}` double" for name in columns.values())
    keep = [c for c in df.columns if c not in keys and c != order]
    n = len(columns)
    made = ordered_fold(df, lambda k: Quantiles(n, q), list(columns), out, keys, order, keep)
    return made.select(*df.columns, *columns.values())
