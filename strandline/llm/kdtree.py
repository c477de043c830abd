"""Exact top-k inner products: a KD-tree in each shard, searched best-first.

Vectors become integers floor(256 x). Rows are dealt to shards; in a shard a tree splits the
rows at medians of the widest dimension, and every node keeps the tight box of its rows. The
largest inner product that a box allows bounds its node. A query goes through the nodes in
order of their bounds and stops when the next bound is below its kth score. That score is
propagated: a first pass over one shard gives every query a kth score to start from in all
the others, and inside a shard it rises as leaves are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.store import written

TOP = 5
#: Rows of a shard, rows of a leaf, queries searched together.
SHARD, LEAF, QUERIES = 16_384, 64, 4_096
#: Components beyond this size lose exactness in double precision: such rows use Python integers.
EXACT = float(1 << 20)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as packed doubles, and whether they are small enough for exact doubles.

    Small ones hold floor(256 x), the others x itself: 256 x may leave the range of doubles.
    """
    for part in parts:
        rows = []
        for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True):
            if v is None or any(c is None for c in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                small = bool((np.abs(x) < EXACT / 256).all())
                rows.append((i, (np.floor(x * 256) if small else x).tobytes(), small))
        i, x, small = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(i, pa.int64()), pa.array(x, pa.binary()), pa.array(small, pa.bool_())], names=["vec_id", "vector", "small"])


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of ``dim`` components; shorter vectors are filled with zeros."""
    out = np.zeros((len(raw), dim))
    for k, r in enumerate(raw):
        out[k, : len(r) // 8] = np.frombuffer(r)
    return out


class Tree:
    """Median splits of the widest dimension down to leaves, with tight boxes."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []

        def grow(a: int, b: int) -> int:
            node = len(self.span)
            rows = x[self.order[a:b]]
            low.append(rows.min(0))
            high.append(rows.max(0))
            self.span.append((a, b))
            self.children.append(None)
            wide = int((high[node] - low[node]).argmax())
            if b - a > leaf and high[node][wide] > low[node][wide]:
                m = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, wide], m)]
                self.children[node] = (grow(a, a + m), grow(a + m, b))
            return node

        grow(0, len(x))
        self.low, self.high = np.array(low), np.array(high)
        self.rows = x[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, top: int, copies: np.ndarray | None = None) -> tuple[list, int]:
    """((query number, score, id) of the best rows at or above each query's floor, leaves read).

    ``copies`` counts the equal rows that each vector stands for; each of them is a find of its own.
    Ties at the kth score go to the smaller id, so nodes whose bound equals it are read too.
    """
    out, read = [], 0
    own, many = ids[tree.order], np.ones(len(ids), int) if copies is None else copies[tree.order]
    bounds = tree.bounds(q)
    for k in range(len(q)):
        best: list[tuple[float, int]] = []  # smallest first: (score, -id)
        kth, up = floor[k], bounds[k]
        heap = [(-up[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if tree.children[node] is not None:
                for c in tree.children[node]:
                    if up[c] >= kth:
                        heapq.heappush(heap, (-up[c], c))
                continue
            read += 1
            a, b = tree.span[node]
            score = tree.rows[a:b] @ q[k]
            for r in np.flatnonzero((score >= kth) & (own[a:b] != q_ids[k])):
                entry = (float(score[r]), -int(own[a + r]))
                for _ in range(min(top, int(many[a + r]))):
                    if len(best) < top:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == top:
                    kth = max(kth, best[0][0])
        out += [(k, int(s), -i) for s, i in best]
    return out, read


def _integers(raw: bytes, small: bool) -> list[int]:
    """The components floor(256 x) as integers of any size."""
    return [int(c) if small else math.floor(256 * Fraction(c)) for c in np.frombuffer(raw).tolist()]


def _slow(ids: list[int], copies: list[int], vectors: list[list[int]], q: list[int], q_id: int, top: int) -> list[tuple[int, int]]:
    """Scores too large for exact doubles, in Python integers; beyond 64 bits they stop at the border."""
    scores = ((min(MOST, max(LEAST, sum(a * b for a, b in zip(q, v, strict=False)))), -i, n) for i, n, v in zip(ids, copies, vectors, strict=True) if i != q_id)
    found = ((s, i) for s, i, n in scores for _ in range(min(top, n)))
    return [(s, -i) for s, i in heapq.nlargest(top, found)]


RESULT = "query_id long, score long, vec_id long"


def _search(shard: pa.Table, queries: pa.Table, top: int) -> pa.Table:
    """The best rows of one shard for one block of queries.

    Small vectors go through the tree.  Only pairs with a large vector on either side are scored
    in integers: large queries against the whole shard, small ones against its large rows.
    """
    found: list[tuple[int, int, int]] = []  # number of the query, score, id
    q_ids = queries.column("query_id").to_numpy()
    if len(shard) and len(queries):
        ids, raw, copies = shard.column("vec_id").to_numpy(), shard.column("vector").to_pylist(), shard.column("copies").to_numpy()
        small, light = (t.column(c).to_numpy(zero_copy_only=False) for t, c in ((shard, "small"), (queries, "light")))
        q_raw, floor, asks = queries.column("asked").to_pylist(), queries.column("floor").to_numpy(), queries.column("asks").to_numpy()
        at, asked = np.flatnonzero(small), np.flatnonzero(light)
        if len(at) and len(asked):
            rows, points = [raw[i] for i in at], [q_raw[k] for k in asked]
            dim = max(len(r) // 8 for r in [*rows, *points])
            got, _ = search(Tree(_matrix(rows, dim)), ids[at], _matrix(points, dim), q_ids[asked], floor[asked], top, copies[at])
            found = [(int(asked[k]), s, i) for k, s, i in got]
        large = np.flatnonzero(~small)
        every = np.arange(len(ids)) if len(asked) < len(q_ids) else large
        whole = {i: _integers(raw[i], small[i]) for i in every.tolist()}
        for k in range(len(q_ids)):
            over = large if light[k] else every
            if len(over):
                q = _integers(q_raw[k], light[k])
                found += [(k, s, i) for s, i in _slow(ids[over].tolist(), copies[over].tolist(), [whole[i] for i in over.tolist()], q, int(q_ids[k]), top)]
        # each of a query's equal rows asks for itself
        found = [f for f in found for _ in range(min(top, int(asks[f[0]])))]
    k, s, i = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"query_id": pa.array([int(q_ids[j]) for j in k], pa.int64()), "score": pa.array(s, pa.int64()), "vec_id": pa.array(i, pa.int64())})


def top_k(embeddings: DataFrame, top: int = TOP, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best rows of every vec_id divisible by ``every``.

    Score: inner product of the integer vectors; ties to the smaller vec_id; all candidates, if
    fewer. A query's own vec_id is no candidate. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part. Every other row is a candidate
    with a rank of its own, equal rows too: they are searched once, with their number. Where rows
    share a query's vec_id, each of them asks and all their finds are ranked together. Shorter
    vectors are filled with zeros, scores stop at the borders of 64 bits. An empty table gives no rows.

    Rows are dealt to shards by hash of vec_id and queries to blocks, both in proportion to the
    table; each (shard, block) pair is one task's group.
    """
    d = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    whole = d.mapInArrow(_whole, "vec_id long, vector binary, small boolean")
    rows = written(whole.groupBy("vec_id", "vector", "small").agg(F.count("*").alias("copies")), "integers")
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // QUERIES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), F.col("small").alias("light"), F.col("copies").alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def ask(asked: DataFrame, shard: F.Column) -> DataFrame:
        """Each query in the shards that ``shard`` lists."""
        q = asked.withColumn("shard", F.explode(shard))
        r = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return r.groupBy("shard", F.col("block").alias("b")).cogroup(q.groupBy("shard", F.col("block").alias("b"))).applyInArrow(partial(_search, top=top), RESULT)

    least = float("-inf")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    first = written(ranked(ask(queries.withColumn("floor", F.lit(least)), F.array(F.col("block") % shards))), "first")
    kth = first.where(F.col("rank") == top).select("query_id", F.col("score").cast("double").alias("kth"))
    rest = queries.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", F.lit(least))).drop("kth")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("block") % shards)
    found = first.select("query_id", "score", "vec_id").union(ask(rest, others))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
