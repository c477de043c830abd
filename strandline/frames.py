"""Window specifications and literal tables shared by all operators."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

KEYS: tuple[str, ...] = ("series_id",)
SEG_KEYS: tuple[str, ...] = ("series_id", "seg")

#: A grid with more rows goes into the plan as one text literal that each task parses.
LITERAL_ROWS = 500


def ordered(keys: Sequence[str] = KEYS, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, keys: Sequence[str] = KEYS, order: str = "ts", delay: int = 0) -> WindowSpec:
    """The ``n`` rows that end ``delay`` rows before the current one.

    The delay lives in the frame, so a lagged rolling statistic costs no second
    window pass (and, after the windows become rows, no second shuffle).
    """
    if n < 1:
        raise ValueError("window length must be at least 1")
    return ordered(keys, order).rowsBetween(-(n - 1) - delay, -delay)


def expanding(keys: Sequence[str] = KEYS, order: str = "ts", delay: int = 0) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -delay)


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def full_only(expr: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """``expr`` where the frame holds ``n`` non-null values of ``x``, else null."""
    return F.when(F.count(x).over(w) == n, expr)


def _json_schema(rows: list[dict], fields: list[str]) -> str | None:
    """Type of the rows as JSON, as literals would have it; None if a value has no JSON form."""
    kinds = []
    for f in fields:
        values = [r[f] for r in rows]
        types = {type(v) for v in values}
        if types <= {int, float}:
            if not all(math.isfinite(v) for v in values):
                return None
            small = types == {int} and all(-(1 << 31) <= v < 1 << 31 for v in values)
            kinds.append(f"`{f}` {'int' if small else 'bigint' if types == {int} else 'double'}")
        elif types == {str}:
            kinds.append(f"`{f}` string")
        else:
            return None
    return f"array<struct<{', '.join(k.replace(' ', ': ', 1) for k in kinds)}>>"


def explode_rows(df: DataFrame, rows: Iterable[dict], name: str = "_p") -> DataFrame:
    """Repeat ``df`` once per literal row and add the row's fields as columns.

    A parameter grid is known on the driver when the plan is written, so it goes
    into the plan as an array literal, a large one as JSON text: no join, no broadcast
    and no limit to its rows.
    """
    rows = list(rows)
    if not rows:
        raise ValueError("the parameter grid is empty")
    fields = list(rows[0])
    clash = set(fields) & set(df.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    schema = _json_schema(rows, fields) if len(rows) > LITERAL_ROWS else None
    if schema is not None:
        grid = F.from_json(F.lit(json.dumps(rows)), schema)
    else:
        grid = F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in rows])
    out = df.withColumn(name, F.explode(grid))
    return out.select(*df.columns, *[F.col(f"{name}.{f}").alias(f) for f in fields])


def stack_rows(df: DataFrame, keep: Sequence[str], rows: Sequence[dict[str, object]]) -> DataFrame:
    """Turn sets of wide columns into rows: each dict maps output name to column or literal."""
    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    structs = [F.struct(*[as_col(v).alias(k) for k, v in r.items()]) for r in rows]
    names = list(rows[0])
    out = df.select(*keep, F.explode(F.array(*structs)).alias("_r"))
    return out.select(*keep, *[F.col(f"_r.{k}").alias(k) for k in names])


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
