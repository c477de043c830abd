"""Best-fit packing planned over the histogram of lengths, not over the documents.

Best fit decreasing treats pieces of one length alike, so its whole course follows from how
many pieces each length has: at most ``capacity`` numbers. The plan gives, for each length,
runs of ranks and the slots they take; pieces are ranked within their length and join it.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.store import texts, written
from strandline.llm.tokens import documents_ids, public_path, release

CAPACITY = 2048
END = 0
#: Pieces ranked by one window group; a length with more is ranked in several.
RANKED = 1_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces a sequence, offset) runs.

    The piece of rank r goes to sequence ``first + (r - first rank) // pieces`` and stands at
    ``offset + (r - first rank) % pieces * length``. Sequences in the same state are kept as
    runs of numbers, so the work depends on the number of lengths only.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    out, opened = [], 0

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in runs:
                bisect.insort(spaces, space)
            runs.setdefault(space, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(spaces, length)
            if k == len(spaces):
                need = -(-left // (capacity // length))
                put(capacity, opened, need)
                opened += need
                continue
            space = spaces[k]
            first, count = runs[space].pop()
            if not runs[space]:
                del runs[space]
                spaces.pop(k)
            each = space // length
            whole = min(count, left // each)
            if whole:
                out.append((length, rank, rank + whole * each, first, each, capacity - space))
                put(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < count and left:
                out.append((length, rank, rank + left, first + whole, each, capacity - space))
                put(space - left * length, first + whole, 1)
                put(space, first + whole + 1, count - whole - 1)
                left = 0
            else:
                put(space, first + whole, count - whole)
    return out


def _cut(parts: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, keep: bool) -> Iterator[pa.RecordBatch]:
    salt = 0
    for part in parts:
        ids_of = part.column("doc_id").to_pylist()
        rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids")}
        for doc, ids in zip(ids_of, documents_ids(part.column("text"), path, end), strict=True):
            raw = ids.astype("<u4").tobytes()
            for k, a in enumerate(range(0, len(ids), capacity)):
                piece = raw[4 * a : 4 * (a + capacity)]
                salt += 1
                for name, x in zip(rows, (doc, k, a, len(piece) // 4, zlib.crc32(piece), salt, piece if keep else None), strict=True):
                    rows[name].append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True)], names=list(rows))
    release(path)


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt, ids): documents as id runs of at most ``capacity``.

    A document is its ids and the end id; a null or empty text is the end id alone. Each piece
    but a document's last is full. ``ids`` holds little-endian unsigned 32-bit ids (null if not
    kept). Null and repeated doc_ids are documents of their own; an empty table has no pieces.
    """
    cut = partial(_cut, path=path or public_path(), capacity=capacity, end=end, keep=keep_ids)
    return texts(documents).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, ids binary")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with sequence_id and offset, in place of salt.

    ``cut`` must be a written table with long columns ``length`` (1 to ``capacity``) and ``salt``
    (any spreading numbers): it is read three times. Only the histogram, of at most ``capacity``
    rows, reaches the driver and is sent back. A length with many pieces is ranked in groups by
    salt, so that no window group grows with the table.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, r0 long, r1 long, first long, each long, place long")
    groups = spark.createDataFrame([(n, -(-k // RANKED)) for n, k in histogram.items()], "length long, groups long")
    ranked = cut.join(F.broadcast(groups), "length").withColumn("part", F.pmod("salt", "groups")).drop("groups")
    sizes = ranked.groupBy("length", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ranked.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own"))
    placed = ranked.join(runs, "length").where("rank >= r0 and rank < r1")
    sequence = F.expr("first + (rank - r0) div each").alias("sequence_id")
    offset = F.expr("place + (rank - r0) % each * length").alias("offset")
    return placed.select(*[c for c in cut.columns if c != "salt"], sequence, offset)


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents and their places in as few sequences as best fit decreasing finds."""
    return place(written(pieces(documents, path, capacity, end, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, ids end to end."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("x"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")).alias("ids"))


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing uses fewer sequences: all tokens, and pieces over half a sequence, need so many."""
    total = sum(n * k for n, k in histogram.items())
    return max(-(-total // capacity), sum(k for n, k in histogram.items() if 2 * n > capacity))


def check_places(rows: list[tuple[int, int, int]], capacity: int = CAPACITY) -> bool:
    """Whether (sequence, offset, length) rows fill each sequence from 0 without gap or overlap."""
    ends: dict[int, int] = {}
    for s, a, n in sorted(rows):
        if ends.get(s, 0) != a:
            return False
        ends[s] = a + n
    return all(np.array(list(ends.values()) or [0]) <= capacity)
