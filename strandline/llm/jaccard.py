"""N-gram Jaccard join: groups of documents whose word-shingle sets are alike.

Documents with the same set are one class; the join works on classes.

1. **Bands.** Set sizes are cut into bands such that two similar sets lie in one band or in
   neighbours. A *tile* is a band with the next one; every set is in two tiles.
2. **Keys.** Similar sets of a tile differ in at most ``D`` shingles, a number that follows from
   the sizes. The shingles are dealt by hash to more than ``D`` parts, so at least one part is
   equal in both sets: its hash is a key. A passage that many documents share makes no common
   key unless it fills a whole part. Empty parts give no key; a set with too many empty parts
   for this argument also uses its smallest shingles as keys (any two such sets share one).
3. **Links.** The smallest set of a key is its hub. Every set is compared with the hubs that
   it shares most keys with, then connected components are taken. Only keys whose sets are
   still in several components go on: small ones as pairs, large ones in blocks, pairs of
   blocks being compared by bitmaps. In a first round a set offers only its likeliest partners
   in a block; most groups grow together on these. The second round covers all pairs that are
   still across components.
4. **Comparing.** A pair's bitmaps (one bit a shingle, by hash) bound the overlap from above:
   a bit that only one has is a shingle that the other lacks. Pairs that the bound leaves are
   settled by intersecting the sorted arrays of shingles.

5. **Counting.** Similar sets lie in one component, so ``linked`` compares all sets of a component
   that differ little enough in size, blocks against blocks, and counts their links where they
   are compared. ``groups`` leaves this out: for components alone, pairs that are already
   connected need no look.

No step emits all pairs of a group of copies: what leaves a task of step 5 is a number per set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.llm.components import roots, stars
from strandline.llm.store import texts, written
from strandline.llm.words import give_back, in_slices, mix, shingles

#: Hubs (smallest set of a key) that a set is compared with first: those of most of its keys.
HUBS = 3
#: Sets of a key up to which its pairs are listed; a key with more is compared by blocks.
LISTED = 8
#: Sets of one key compared in one task; a key with more is cut into blocks.
BLOCK = 1024
#: Sets of one component, and shingles of them, whose links are counted in one task with as many others.
COUNTED, SHINGLES = 128, 1 << 20
#: Bits of a bitmap: the power of two from four times the set's size on, within these bounds.
BITS = (64, 1 << 16)
#: Likeliest partners that a set offers in each block before all its pairs are compared.
LIKELIEST = 2
#: Largest keys under which a set does so.
OFFERED = 2


class Tiles:
    """Bands of set sizes for a threshold of ``percent`` hundredths, and the keys of a set."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [1]

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            top = self.tops[-1]
            self.tops.append(max(top + 1, 100 * top // self.percent))
        return int(np.searchsorted(self.tops, n))

    def parts(self, band: int) -> tuple[int, int]:
        """(most shingles by which similar sets of the tile differ, number of parts)."""
        top = self.tops[band]
        differ = (top + 100 * top // self.percent) * (100 - self.percent) // (100 + self.percent)
        return differ, differ + 2 + differ // 32

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Keys of a set given as sorted distinct hashes; similar but unequal sets share one."""
        n = len(h)
        if not n:
            return h
        own, out = self.band(n), []
        spread = mix(h)
        for tile in (own - 1, own):
            if tile < 0:
                continue
            differ, parts = self.parts(tile)
            if not differ:
                continue  # similar sets of this tile are equal
            part = (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            salt = mix(np.array([(tile << 1) + 1], np.uint64))[0]
            out.append(mix(np.add.reduceat(spread, first) ^ mix(part[first] + salt)))
            if parts - len(first) >= parts - differ:
                least = -(-self.percent * n // 100)
                out.append(mix(h[: n - least + 1] ^ (salt + np.uint64(1))))
        return np.concatenate(out) if out else h[:0]


def bitmap(h: np.ndarray) -> np.ndarray:
    """One bit per shingle hash, in a power of two of bits that follows from the set's size."""
    width = min(max(BITS[0], 1 << (4 * len(h) - 1).bit_length()), BITS[1])
    bits = np.zeros(width, np.uint8)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def most_common(x: np.ndarray, nx, y: np.ndarray, ny) -> np.ndarray:
    """Upper bound of the overlap of sets with these bitmaps (last axis) and sizes."""
    return np.minimum(nx - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))


def similar(common, nx, ny, percent: int):
    """Whether 100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (nx + ny)


def _name(h: np.ndarray) -> int:
    """A set's id: 64 bits of its members' hashes. Sets are taken as equal if size and id are."""
    total = mix(np.array([np.add.reduce(mix(h ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(h))], np.uint64))
    return int(total.view(np.int64)[0])


def _summaries(parts: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, n_shingles, set_id, keys); keys only with the first copy that this task meets."""
    tiles, seen = Tiles(percent), set()
    for part in in_slices(parts):
        sizes, names, lengths, flat = [], [], [], []
        for _, h in shingles(part.column("text"), width):
            name = _name(h) if len(h) else None
            fresh = name is not None and name not in seen
            seen.add(name)
            keys = tiles.keys(h) if fresh else h[:0]
            sizes.append(len(h))
            names.append(name)
            lengths.append(len(keys))
            flat.append(keys)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), keys], names=["doc_id", "text_hash", "n_shingles", "set_id", "keys"])


def _sets(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The sets themselves, each once in a task."""
    seen: set[int] = set()
    for part in in_slices(parts):
        fresh = [not (x in seen or seen.add(x)) for x in part.column("set_id").to_pylist()]
        part = part.filter(pa.array(fresh, pa.bool_()))
        wanted = part.column("set_id").to_pylist()
        rows = [(x, len(h), bitmap(h).tobytes(), h.tobytes()) for (_, h), x in zip(shingles(part.column("text"), width), wanted, strict=True) if len(h) and _name(h) == x]
        x, n, bits, members = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = [pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(members, pa.binary())]
        yield pa.record_batch(columns, names=["set_id", "n", "bits", "members"])


def _bounded(parts: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps do not rule them out."""
    for part in in_slices(parts):
        keep = []
        for n, x, m, y in zip(*(part.column(c).to_pylist() for c in ("a_n", "a_bits", "b_n", "b_bits")), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            keep.append(bool(similar(most_common(folded(x, words), n, folded(y, words), m), n, m, percent)))
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _exact(parts: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for part in in_slices(parts):
        keep = []
        for x, y in zip(part.column("a_members").to_pylist(), part.column("b_members").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            keep.append(bool(similar(int((y[at] == x).sum()), len(x), len(y), percent)))
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: first by bitmaps, then exactly."""

    def beside(df: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            df = df.join(sets.select(F.col("set_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return df

    left = beside(pairs, "n", "bits").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
    left = left.mapInArrow(partial(_bounded, percent=percent), "a long, b long")
    both = beside(left, "members").select("a", "b", "a_members", "b_members")
    return both.mapInArrow(partial(_exact, percent=percent), "a long, b long")


def _earlier(keys: pa.ChunkedArray) -> np.ndarray:
    """Which of the keys that several sets have each set has, a row of zeros and ones for each set."""
    keys = keys.combine_chunks()
    owner = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
    known, place = np.unique(keys.flatten().to_numpy(), return_inverse=True)
    held = np.bincount(place, minlength=len(known)) > 1
    column = np.cumsum(held) - 1
    some = held[place]
    out = np.zeros((len(keys), int(held.sum())), np.float32)
    out[owner[some], column[place[some]]] = 1.0
    return out


def _tile_pairs(key, rows: pa.Table, percent: int, likeliest: int | None) -> pa.Table:
    """Pairs of different components from one pair of blocks that the bitmaps do not rule out.

    With ``likeliest`` only so many for each set: those of the largest bounds. If the rows hold
    the sets' smaller keys, a pair comes out under its smallest common key and under no other.
    """
    rows = rows.sort_by("set_id")
    earlier = _earlier(rows.column("keys")) if "keys" in rows.column_names else None
    ids, root, n, side = (rows.column(c).to_numpy() for c in ("set_id", "root", "n", "side"))
    same = key[1].as_py() == key[2].as_py()
    raw = [np.frombuffer(x, np.uint64) for x in rows.column("bits").to_pylist()]
    words = min(map(len, raw))
    bits = np.stack([folded(x, words) for x in raw])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
    a, b = [], []
    step = max(1, (1 << 22) // (8 * words * max(1, len(right))))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        bound = most_common(bits[some, None], n[some, None], bits[None, right], n[None, right])
        fit = similar(bound, n[some, None], n[None, right], percent)
        fit &= (root[some, None] != root[None, right]) & ((some[:, None] < right[None]) if same else True)
        if earlier is not None:
            fit &= earlier[some] @ earlier[right].T == 0
        if likeliest is not None:
            bound = np.where(fit, bound, -1)
            fit = np.zeros_like(fit)
            for axis in (0, 1):
                if bound.shape[axis] > likeliest:
                    best = np.argpartition(-bound, likeliest - 1, axis=axis)
                    best = np.take(best, range(likeliest), axis=axis)
                    np.put_along_axis(fit, best, True, axis=axis)
                else:
                    fit[:] = True
            fit &= bound >= 0
        i, j = np.nonzero(fit)
        a.append(ids[some[i]])
        b.append(ids[right[j]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    if len(ids) >= BLOCK // 2:
        del raw, bits, rows
        give_back()
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _tile_sets(key, rows: pa.Table, percent: int) -> pa.Table:
    """The sets that have a possible partner in one pair of blocks, each once, with the key."""
    pairs = _tile_pairs(key, rows, percent, None)
    found = np.unique(np.concatenate([pairs.column(c).to_numpy() for c in ("a", "b")]))
    return pa.table({"key": np.full(len(found), key[0].as_py(), np.int64), "set_id": found})


def _dealt(held: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of each key for all pairs of the key's blocks."""
    held = held.withColumn("blocks", F.expr(f"cast(ceil(size / {BLOCK}) as int)"))
    held = held.withColumn("block", F.expr("pmod(xxhash64(set_id), blocks)").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = held.select("key", "set_id", "root", "block", other).select(
        "key", "set_id", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    return dealt.join(sets, "set_id")


def _open_pairs(buckets: DataFrame, reached: DataFrame, sets: DataFrame, percent: int, likeliest: int | None) -> DataFrame:
    """Possible links between components that share a key."""
    held = buckets.select("key", "set_id").join(reached.select(F.col("v").alias("set_id"), "root"), "set_id", "left")
    held = held.select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
    open_keys = held.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 <> r1")
    held = written(held.join(open_keys.select("key", "size"), "key"), "open")
    few = held.where(F.col("size") <= LISTED)
    left, right = (few.select("key", F.col("set_id").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
    listed = left.join(right, "key").where("a < b and a_root <> b_root").select("a", "b")
    held, bits = held.where(F.col("size") > LISTED), sets.select("set_id", "n", "bits")
    if likeliest is not None:
        largest = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("size"), "key"))
        held = held.withColumn("k", largest).where(F.col("k") <= OFFERED)
        found = _dealt(held, bits).groupBy("key", "i", "j").applyInArrow(lambda key, rows: _tile_pairs(key, rows, percent, likeliest), "a long, b long")
    else:
        # first under which keys a set has a possible partner at all: only those sets go on, with these keys
        hit = _dealt(held, bits).groupBy("key", "i", "j").applyInArrow(lambda key, rows: _tile_sets(key, rows, percent), "key long, set_id long")
        hit = written(hit.distinct(), "hits")
        own = hit.groupBy("set_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        some = held.join(hit, ["key", "set_id"], "left_semi")
        dealt = _dealt(some, bits.join(own, "set_id")).withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))
        found = dealt.groupBy("key", "i", "j").applyInArrow(lambda key, rows: _tile_pairs(key, rows, percent, None), "a long, b long")
    return listed.union(found).distinct()


def _counts(key, rows: pa.Table, percent: int) -> pa.Table:
    """(set_id, links) from two blocks of one component, or inside one: similar sets, copies counted."""
    rows = rows.sort_by([("side", "ascending"), ("n", "ascending"), ("set_id", "ascending")])
    ids = rows.column("set_id").to_numpy()
    rows = rows.take(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))))  # a set may have several equal rows
    ids, n, copies, side = (rows.column(c).to_numpy() for c in ("set_id", "n", "copies", "side"))
    same, half = key[1].as_py() == key[2].as_py(), int((side == 0).sum())
    flat = np.unique(np.frombuffer(b"".join(rows.column("members").to_pylist()), np.uint64), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(n)))
    held, links = np.zeros(len(flat), np.int32), np.zeros(len(ids), np.int64)
    for k in range(half):
        first = k + 1 if same else half
        i = first + int(np.searchsorted(n[first:], -(-percent * n[k] // 100)))
        j = first + int(np.searchsorted(n[first:], 100 * n[k] // percent, "right"))
        if i >= j:
            continue
        own = flat[starts[k] : starts[k + 1]]
        held[own] = 1
        common = np.add.reduceat(held[flat[starts[i] : starts[j]]], starts[i:j] - starts[i])
        held[own] = 0
        near = similar(common.astype(np.int64), n[k], n[i:j], percent)
        links[k] += copies[i:j][near].sum()
        links[i:j][near] += copies[k]
    return pa.table({"set_id": ids, "links": links}).filter(pa.array(links > 0))


def _link_counts(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set_id, links): documents with another, similar set. ``classes``: (set_id, root, n, copies)."""
    sizes = classes.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    blocks = F.expr(f"cast(ceil(greatest(size / {COUNTED}, shingles / {SHINGLES})) as int)").alias("blocks")
    held = classes.drop("n").join(sizes.select("root", blocks), "root").withColumn("block", F.expr("cast(pmod(xxhash64(set_id), blocks) as int)"))
    dealt = held.join(sets.select("set_id", "n", "members"), "set_id").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("root", "set_id", "copies", "n", "members", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("if(block <= other, 0, 1)").alias("side"))
    found = dealt.groupBy("root", "i", "j").applyInArrow(lambda key, rows: _counts(key, rows, percent), "set_id long, links long")
    return found.groupBy("set_id").agg(F.sum("links").alias("links"))


def linked(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, set_id, n_links, component_id): one row per row of ``documents``.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``width``-word shingles (lower-cased A-Z, words between white space; a shorter text is one
    shingle). ``n_links`` is the number of other rows that a row is linked with, copies included;
    ``component_id`` is the smallest doc_id that links reach. Null, empty and blank texts have no
    shingle, no link and reach only themselves. Repeated doc_ids are rows of their own; a null
    doc_id is linked by its text but never names a component unless it is alone.
    """
    rows, sets = _found(documents, width, percent)
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min("root").alias("root"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    counts = classes.join(_link_counts(classes, sets, percent), "set_id", "left")
    counts = counts.select("set_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = rows.join(written(counts, "counts"), "set_id", "left")
    return rows.select("doc_id", "n_shingles", "set_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")


def groups(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``linked`` without n_links, with text_hash (which text of a repeated doc_id) and root (the group's smallest set id)."""
    return _found(documents, width, percent)[0]


def _found(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``groups``, and the sets (set_id, n, bits, members) that share a key with another."""
    d = texts(documents)
    summary = written(
        d.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            partial(_summaries, width=width, percent=percent), "doc_id long, text_hash long, n_shingles long, set_id long, keys array<long>"
        ),
        "summary",
    )
    exploded = summary.select("set_id", F.explode("keys").alias("key"))
    buckets = exploded.selectExpr("key", "set_id", "min(set_id) over (partition by key) as hub", "max(set_id) over (partition by key) as top")
    buckets = written(buckets.where("hub <> top").select("key", "set_id", "hub"), "buckets")
    wanted = buckets.select("set_id").distinct()
    named = _first_texts(d, summary, wanted).mapInArrow(partial(_sets, width=width), "set_id long, n long, bits binary, members binary")
    sets = written(named, "sets")
    shared = buckets.where("hub <> set_id").groupBy("hub", "set_id").agg(F.count("*").alias("n"))
    most = Window.partitionBy("set_id").orderBy(F.desc("n"), "hub")
    hubs = written(shared.withColumn("k", F.row_number().over(most)).where(F.col("k") <= HUBS).select(F.col("hub").alias("a"), F.col("set_id").alias("b")), "hubs")
    links, tested = stars(written(_compare(hubs, sets, percent), "links"), 2), hubs
    for likeliest in (LIKELIEST, None):
        # connected so far, for certain: enough to leave out pairs
        pairs = _open_pairs(buckets, roots(links), sets, percent, likeliest)
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = links.union(written(_compare(pairs, sets, percent), "links"))
        links = stars(links, None if likeliest is None else 2)
        tested = tested.union(pairs)
    return _named(summary, roots(links)), sets


def _first_texts(d: DataFrame, summary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text) of each wanted set's first row: found by doc_id and text, as many rows may share or lack a doc_id."""
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))).alias("x")
    first = summary.where("set_id is not null").groupBy("set_id").agg(first).join(wanted, "set_id").select("set_id", "x.*")
    keyed = d.select("text", F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    return keyed.join(first, ["no_id", "id", "hash"]).select("set_id", "text")


def _named(summary: DataFrame, reached: DataFrame) -> DataFrame:
    """Components by smallest doc_id: of the set's root, then of its documents."""
    rows = summary.select("doc_id", "text_hash", "n_shingles", "set_id").join(reached.select(F.col("v").alias("set_id"), "root"), "set_id", "left")
    rows = rows.withColumn("root", F.coalesce("root", "set_id"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, "root", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", "set_id", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``documents`` that stay when of each group of linked documents one does.

    It is the one with the smallest doc_id (a null is the largest), then the smallest text
    hash. Rows without a shingle are groups of their own. All columns are kept as they are.
    """
    rows = groups(documents, width, percent)
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"))).alias("x")
    stay = rows.where("root is not null").groupBy("root").agg(first).select("x.*", F.lit(True).alias("chosen"))
    bare = rows.where("root is null").select(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash"), F.lit(False).alias("chosen"))
    stay = stay.union(bare.distinct())
    d = documents.select(F.struct("*").alias("row")).withColumn("id", F.expr("cast(row.doc_id as bigint)"))
    d = d.select("row", F.isnull("id").alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("hash"))
    kept = d.join(stay, ["no_id", "id", "hash"])
    # equal rows of one doc_id are one group as well
    same = F.row_number().over(Window.partitionBy("no_id", "id", "hash").orderBy("chosen"))
    return kept.withColumn("same", same).where("same = 1 or not chosen").select("row.*")
