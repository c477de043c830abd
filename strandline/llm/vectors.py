"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosines.

Two vectors at the threshold agree in one sign with probability 1 - angle / pi. From the
number of distinct vectors follow the signs of a table (so that a bucket of unrelated vectors
stays small) and the number of tables (so that a pair at the threshold meets in one of them
with probability ``RECALL``; closer pairs meet more often). All pairs of a bucket are compared
exactly, in double precision, blocks against blocks; no pair leaves its task: what comes out
is how many links each vector has and which vector of its block it is connected to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.components import components
from strandline.llm.store import written

COSINE = 0.9
RECALL = 0.999
#: Unrelated vectors expected in a bucket; vectors of one bucket compared in one task.
BUCKET, BLOCK = 128, 1024
SEED = 20


def tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a table, tables) for ``n`` distinct vectors."""
    signs = max(4, math.ceil(math.log2(max(1, n) / BUCKET))) if n > BUCKET else 4
    agree = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def valid(column: str = "embedding") -> F.Column:
    """Not null, not all zero, every component finite."""
    return F.expr(f"{column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)")


def unit(raw: list, width: str) -> np.ndarray:
    """Vectors of one length as rows of norm 1; scaled by powers of two first, so nothing overflows."""
    x = np.stack([np.frombuffer(r, width) for r in raw]).astype(np.float64)
    _, e = np.frexp(np.abs(x).max(1))
    x = np.ldexp(x, -e[:, None])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(parts: Iterator[pa.RecordBatch], signs: int, count: int, width: str) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for part in parts:
        raw = part.column("vector").to_pylist()
        out = np.zeros((len(raw), count), np.int64)
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            d = int(size) // np.dtype(width).itemsize
            if d not in planes:
                planes[d] = np.random.default_rng([SEED, d]).normal(size=(d, count * signs))
            bits = (unit([raw[k] for k in rows], width) @ planes[d] > 0).reshape(len(rows), count, signs)
            out[rows] = bits @ (1 << np.arange(signs)) + (d << signs)
        codes = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), count).cast(pa.list_(pa.int64()))
        yield pa.record_batch([*part.columns, codes], names=[*part.schema.names, "codes"])


def _linked(key, rows: pa.Table, cosine: float, width: str) -> pa.Table:
    """Links between two blocks of a bucket, or inside one: (class_id, root, links) per vector with any.

    ``links`` counts vectors, copies included, and leaves out pairs that an earlier table has.
    """
    number, _, i, j = (k.as_py() for k in key)
    rows = rows.sort_by("class_id")
    ids, copies, side = (rows.column(c).to_numpy() for c in ("class_id", "copies", "side"))
    x = unit(rows.column("vector").to_pylist(), width)
    codes = np.stack(rows.column("codes").to_numpy()) if len(rows) else np.zeros((0, 0))
    near = x @ x.T >= cosine - 1e-9
    near &= side[:, None] != side[None] if i != j else ~np.eye(len(x), dtype=bool)
    a, b = np.nonzero(np.triu(near))
    true = (x[a] * x[b]).sum(1) >= cosine
    near[a[~true], b[~true]] = near[b[~true], a[~true]] = False
    a, b = a[true], b[true]
    fresh = ~(codes[a, :number] == codes[b, :number]).any(1)
    links = np.zeros(len(x), np.int64)
    np.add.at(links, a[fresh], copies[b[fresh]])
    np.add.at(links, b[fresh], copies[a[fresh]])
    root = np.arange(len(x))
    while len(x):
        least = np.minimum(root, np.where(near, root[None], len(x)).min(1))
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    some = near.any(1)
    return pa.table({"class_id": ids[some], "root": ids[root[some]], "links": links[some]})


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``embeddings``.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, and
    no two vectors of different length are linked. Equal vectors are one class, whatever their
    number. Repeated vec_ids are rows of their own; a null vec_id is linked by its vector but
    never names a component. An empty table gives no rows.
    """
    single = dict(embeddings.dtypes)["embedding"] == "array<float>"
    kind, width = ("float", "<f4") if single else ("double", "<f8")
    d = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    # zero has two forms; adding 0.0 leaves one, so that equal vectors hash alike
    d = d.withColumn("embedding", F.expr(f"transform(embedding, x -> x + cast(0 as {kind}))"))
    d = d.withColumn("class_id", F.when(valid(), F.xxhash64("embedding")))
    classes = d.where("class_id is not null").groupBy("class_id").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    packed = classes.mapInArrow(partial(_packed, width=width), "class_id long, copies long, vector binary")
    classes = written(packed, "vectors")
    signs, count = tables(classes.count(), cosine, recall)
    coded = written(classes.mapInArrow(partial(_codes, signs=signs, count=count, width=width), "class_id long, copies long, vector binary, codes array<long>"), "codes")
    places = coded.select("class_id", F.posexplode("codes").alias("number", "code"))
    sizes = places.groupBy("number", "code").agg(F.count("*").alias("size")).where("size > 1")
    sizes = sizes.select("number", "code", F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("blocks"))
    dealt = coded.select("class_id", "copies", "vector", "codes", F.posexplode("codes").alias("number", "code")).join(sizes, ["number", "code"])
    dealt = dealt.withColumn("block", F.expr("cast(pmod(class_id, blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("class_id", "copies", "vector", "codes", "number", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("if(block <= other, 0, 1)").alias("side"))
    found = dealt.groupBy("number", "code", "i", "j").applyInArrow(lambda key, rows: _linked(key, rows, cosine, width), "class_id long, root long, links long")
    found = written(found, "found")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("class_id", "copies").join(links, "class_id", "left").join(roots.withColumnRenamed("v", "class_id"), "class_id", "left")
    of_class = of_class.select("class_id", F.coalesce("root", "class_id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = d.select("vec_id", "class_id").join(of_class, "class_id", "left")
    least = rows.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    rows = rows.join(least, "root", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _packed(parts: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    for part in parts:
        raw = [np.asarray(v, width).tobytes() for v in part.column("embedding").to_numpy(zero_copy_only=False)]
        yield pa.record_batch([part.column("class_id"), part.column("copies"), pa.array(raw, pa.binary())], names=["class_id", "copies", "vector"])
