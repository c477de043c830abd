"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F

from strandline.llm.store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each vertex on the smallest of them (larger or smaller ones only)."""
    # both ends from one look at the links: a union would plan all that made them once for each end
    both = edges.selectExpr("inline(array(struct(a as v, b as w), struct(b as v, a as w)))") if large else edges.selectExpr("a as v", "b as w")
    least = both.groupBy("v").agg(F.min("w").alias("least"))
    least = least.select("v", F.least("v", "least").alias("least"))
    around = both.join(least, "v")
    if large:
        out = around.where("w > v").select(F.col("w").alias("a"), F.col("least").alias("b"))
    else:
        out = around.select(F.explode(F.array("w", "v")).alias("a"), F.col("least").alias("b"))
    return out.where("a <> b")


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex hangs on one other that hangs on none: only a yes or no reaches the driver."""
    ends = edges.selectExpr("inline(array(struct(a as v, 1 as up, 0 as down), struct(b as v, 0 as up, 1 as down)))")
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def stars(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Links (a, b), a > b, that connect the same vertices as ``links``, drawn towards the smallest.

    Without ``rounds`` every component ends as one star round its smallest vertex; after a
    number of rounds it may still be several that are linked.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for k in itertools.count(1):
        edges = written(_star(_star(edges, True), False).distinct(), "edges")
        if k == rounds or rounds is None and _settled(edges):
            return edges


def roots(edges: DataFrame) -> DataFrame:
    """(v, root) from ``stars``: vertices of one root are connected."""
    reached = edges.select(F.explode(F.array("a", "b")).alias("v"), F.col("b").alias("root"))
    return reached.groupBy("v").agg(F.min("root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex that has a link.

    ``links`` has long columns ``a`` and ``b`` in either direction; loops, repeated links and
    nulls do not matter. Vertices without a link to another vertex are not returned; an empty
    table gives an empty result. Each round is written to the shared folder.
    """
    return roots(stars(links))
