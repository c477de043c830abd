"""Gapless numbers for the rows of a large table, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.store import written


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... within ``group``, ascending by ``order``) and ``n`` (rows of the group).

    Rows are cut into sorted ranges of (group, order) and written with their place in the range;
    the counts of each range and group are added up, so a group of any size is spread over as
    many tasks as it fills ranges. ``group`` must not be null and ``order`` should end in a
    unique column: equal rows then never pile up in one range, and a repeated task gives the same
    places. Nulls of ``order`` come first.
    """
    keys = [group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, name).withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    all_parts = Window.partitionBy(group).orderBy("part")
    before = F.sum("rows").over(all_parts.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("rows").over(Window.partitionBy(group))
    starts = counts.select("part", group, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), total.alias("n"))
    return placed.join(starts, ["part", group]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")
