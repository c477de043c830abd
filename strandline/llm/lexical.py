"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold.

The documents' words are read once for each block of items and kept as rows of (term, times)
for the block's terms alone. From these come the corpus counts, and with them the weights. The
second pass takes the documents in blocks. There every term is a bitmap over the block's
documents; the bitmaps of an item's terms, read across, give each document's mask. A mask can
score at most the sum of its terms' best contributions in the block. Masks are taken in
descending order of that bound, and the item is finished when no bound left reaches its tenth
best score, which is carried on from block to block of a task. Each task gives ten rows an item
at most; a window over those picks the ten best of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.store import texts, written
from strandline.llm.words import LOWER, hashes, slices, spans

TOP = 10
#: Distinct terms of the items that share a pass over the documents.
BLOCK_TERMS = 1 << 13
#: Documents compared at once, fewer if the block has many terms.
BLOCK_ROWS, BLOCK_CELLS = 1 << 11, 1 << 22
#: Bytes that belong to no term: ASCII but for digits and letters.
GAP = np.ones(256, dtype=bool)
GAP[128:] = False
GAP[48:58] = GAP[65:91] = GAP[97:123] = False


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all terms of a run of texts, offsets of the texts in them)."""
    for row, data, offsets in slices(column):
        data = LOWER[data]
        starts, ends, counts = spans(data, offsets, GAP)
        yield row, hashes(data, starts, ends), counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, times) of every item, terms as hashes."""
    for batch in batches:
        for row, found, counts in _terms(batch.column(1)):
            ids = batch.column(0).slice(row, len(counts) - 1).to_pylist()
            for k, item in enumerate(ids):
                terms, times = np.unique(found[counts[k] : counts[k + 1]], return_counts=True)
                if len(terms):
                    columns = [pa.array(np.full(len(terms), item, np.int64)), pa.array(terms.view(np.int64)), pa.array(times.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "term", "times"])


def _count(vocabulary: np.ndarray):
    """Documents to (doc_id, n, terms, times): places in ``vocabulary`` and how often each occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found, counts in _terms(batch.column(1)):
                size = len(counts) - 1
                at = np.searchsorted(vocabulary, found)
                at[at == len(vocabulary)] = 0
                known = np.flatnonzero(vocabulary[at] == found)
                owner = np.searchsorted(counts, known, side="right") - 1
                cell, times = np.unique(owner * len(vocabulary) + at[known], return_counts=True)
                lists = np.searchsorted(cell // len(vocabulary), np.arange(size + 1)).astype(np.int32)
                columns = [
                    batch.column(0).slice(row, size),
                    pa.array(np.diff(counts).astype(np.int64)),
                    pa.ListArray.from_arrays(lists, pa.array((cell % len(vocabulary)).astype(np.int32))),
                    pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "times"])

    return rows


def _best(found: list[tuple[int, float, int | None]], top: int) -> list:
    """The ``top`` first of (score, order of the id, id): ids ascend, rows without one come last."""
    return sorted(found, key=lambda x: (-x[0], x[1], x[2] or 0))[:top]


class Item:
    """One query: its terms as places in the block's vocabulary, with weights and repeats."""

    def __init__(self, terms: np.ndarray, factors: np.ndarray):
        live = factors > 0
        self.terms, self.factors = terms[live], factors[live]

    def masks(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct masks of the block's documents, and which documents have which.

        ``present`` has a bitmap row for each term of the vocabulary.
        """
        bits = np.unpackbits(present[self.terms], axis=1, bitorder="little")
        words = np.ascontiguousarray(np.packbits(bits, axis=0).T)
        keys = words.view([("", words.dtype)] * words.shape[1]).ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        return bits[:, first].astype(np.int64), group.ravel()

    def search(self, present: np.ndarray, gains: np.ndarray, ids: list[int | None], best: list, top: int) -> list:
        """``best`` with this block's documents; ``gains`` are contributions before the weight, term by document."""
        if not len(self.terms):
            return best
        mask, group = self.masks(present)
        group = group[: len(ids)]
        bound = (self.factors * gains[self.terms].max(axis=1)) @ mask
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(bound) + 1))
        by_bound = np.argsort(-bound, kind="stable")
        step = 0
        while step < len(by_bound):
            # masks of one go: about as many documents as are kept
            last, size = step, 0
            floor = best[-1][0] if len(best) == top else 1
            while last < len(by_bound) and size < 4 * top and bound[by_bound[last]] >= max(floor, 1):
                size += int(cuts[by_bound[last] + 1] - cuts[by_bound[last]])
                last += 1
            if last == step:
                break
            docs = np.concatenate([order[cuts[m] : cuts[m + 1]] for m in by_bound[step:last]])
            scores = self.factors @ gains[np.ix_(self.terms, docs)]
            worth = scores >= max(floor, 1)
            new = [(int(s), ids[d] is None, ids[d]) for s, d in zip(scores[worth], docs[worth], strict=True)]
            best = _best(best + new, top)
            step = last
        return best


def _rank(items: dict[int, tuple[np.ndarray, np.ndarray]], vocabulary: int, documents: int, words: int, top: int):
    """Rows of ``_count`` to (item, doc_id, score): the task's best documents of every item."""
    rows_at_once = max(64, min(BLOCK_ROWS, BLOCK_CELLS // max(1, vocabulary)))

    def gain(n: np.ndarray, times: np.ndarray) -> np.ndarray:
        m = 100 - 75 + (75 * n * documents) // words
        return (1_000_000_000 * times) // (1000 * times + 8 * m)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {k: Item(*v) for k, v in items.items()}
        best: dict[int, list] = {k: [] for k in items}
        for batch in batches:
            for a in range(0, len(batch), rows_at_once):
                part = batch.slice(a, rows_at_once)
                ids, n = part.column(0).to_pylist(), part.column(1).to_numpy()
                lengths = part.column(2).value_lengths().to_numpy()
                owner = np.repeat(np.arange(len(ids)), lengths)
                term = part.column(2).flatten().to_numpy()
                times = part.column(3).flatten().to_numpy().astype(np.int64)
                gains = np.zeros((vocabulary, len(ids)), np.int64)
                gains[term, owner] = gain(n[owner], times)
                present = np.packbits(gains > 0, axis=1, bitorder="little")
                for k, item in queries.items():
                    best[k] = item.search(present, gains, ids, best[k], top)
        found = [(k, i, s) for k, rows in best.items() for s, _, i in rows]
        names, types = ["item", "doc_id", "score"], [pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array([r[c] for r in found], t) for c, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _block(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame | None:
    """(item, doc_id, score) of the items of one block, at most ``top`` an item and task."""
    wanted = terms.collect()  # a block: BLOCK_TERMS by its making
    if not wanted:
        return None
    vocabulary = np.unique(np.array([r.term for r in wanted], np.int64).view(np.uint64))
    counted = written(docs.mapInArrow(_count(vocabulary), "doc_id bigint, n bigint, terms array<int>, times array<int>"), "terms")
    size = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not size[0]:
        return None
    holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([weight(size[0], holding.get(k, 0)) for k in range(len(vocabulary))], np.int64)
    items: dict[int, list] = {}
    for r in wanted:
        place = int(np.searchsorted(vocabulary, np.array([r.term], np.int64).view(np.uint64))[0])
        items.setdefault(r["item"], []).append((place, r.times * int(weights[place])))
    packed = {k: (np.array([p for p, _ in v]), np.array([w for _, w in v], np.int64)) for k, v in items.items()}
    hits = counted.where("size(terms) > 0").select("doc_id", "n", "terms", "times")
    return hits.mapInArrow(_rank(packed, len(vocabulary), size[0], size[1], top), "item bigint, doc_id bigint, score bigint")


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item.

    Terms are runs of ASCII letters and digits and of signs beyond ASCII; only A-Z are
    lower-cased. Every row of ``documents`` is a document, repeated rows too; texts are read
    whole. Equal scores go by doc_id, rows without one last. Null, empty and term-less texts
    match nothing, as items and as documents. Equal rows of ``items`` are one item; different
    texts under one item_id, null included, are items of their own. Columns other than the id
    and the text are not read. Without documents, items or common terms there are no rows.

    Items go through the documents in blocks of about BLOCK_TERMS terms, dealt by hash, so what
    a task and the driver hold does not grow with either table.
    """
    docs = texts(documents)
    asked = items.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text").where("text is not null").distinct()
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = written(asked.select("item", "text").mapInArrow(_item_terms, "item bigint, term bigint, times bigint"), "item_terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    found = [_block(docs, terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), top) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return asked.limit(0).selectExpr("item_id", "cast(0 as int) as rank", "0L as doc_id", "0L as score")
    rows = written(reduce(DataFrame.unionByName, found), "found")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    first = rows.select("*", rank.alias("rank")).where(F.col("rank") <= top)
    return first.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
