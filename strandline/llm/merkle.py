"""A Merkle manifest of a table with proofs by pointer jumping.

Leaves of a source, and then the subroots of all sources, are hashed in runs of sixteen, level
by level. Every inner node then holds a segment (its siblings to the left and to the right) and
a pointer to its parent. A round of self-joins follows the pointers of the pointers and appends
the segments found there, so the distance to the ancestor doubles until it is the root; leaves
take their parent's finished segments in the last join.

Only inner nodes jump: a fifteenth of the rows. Many nodes point to the few ancestors near the
root; those joins have one row for each ancestor on the other side, so adaptive execution either
broadcasts that side by its measured size or splits the hot partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.ranks import numbered
from strandline.llm.store import written

RUN = 16
#: Names of trees start with "=" (a source) or are empty (no source), so this one is free.
TOP = "top"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _leaf(text: Column) -> Column:
    """Every field as byte count, colon and value, so that no two rows write the same bytes."""
    values = [F.col(c).cast("string") for c in FIELDS] + [text]
    return digest(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))


def leaves(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed, uid): ``changed`` is the leaf of the tampered row, null where the row is left alone."""
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return documents.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _leaf(text).alias("leaf"),
        F.when(chosen, _leaf(F.translate(text, UPPER, LOWER))).alias("changed"),
        F.monotonically_increasing_id().alias("uid"),
    )


def _parents(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """The next level of all trees that still have several nodes; ``kids`` are a run's nodes in order."""
    runs = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {RUN}").alias("run"), "n")
    runs = runs.agg(F.sort_array(F.collect_list(F.struct("idx", "hash", *extra))).alias("kids"))
    return runs.select(
        "tree",
        F.col("run").alias("idx"),
        F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"),
        digest(F.array_join("kids.hash", "")).alias("hash"),
        "kids",
    )


def _levels(nodes: DataFrame, extra: list[str], name: str) -> list[DataFrame]:
    """Written tables of the levels above ``nodes``: a sixteenth of the rows each time.

    How many there are follows from the largest tree, the one number that comes to the driver.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    while most > 1:
        nodes = written(_parents(nodes, [] if out else extra), f"{name}_{len(out) + 1}")
        out.append(nodes)
        most = -(-most // RUN)
    return out


def _segment(kids: str, i: str) -> Column:
    """Digests left and right of the ``i``-th (from 0) node of a run."""
    joined = "array_join(slice({kids}.hash, {a}, {n}), '')"
    left, right = joined.format(kids=kids, a=1, n=i), joined.format(kids=kids, a=f"{i} + 2", n=RUN)
    return F.struct(F.expr(left).alias("left"), F.expr(right).alias("right"))


def _children(parents: DataFrame, level: int, tree: Column, idx: Column, own: Column, sub: Column) -> DataFrame:
    """A row for each node below ``parents`` (of ``level``): who it is, where it points, what lies beside it."""
    kids = parents.select("*", F.posexplode("kids").alias("i", "kid"))
    return kids.select(
        tree.alias("tree"),
        own.cast("int").alias("level"),
        idx.alias("idx"),
        F.col("tree").alias("up_tree"),
        F.lit(level).alias("up_level"),
        F.col("idx").alias("up_idx"),
        F.array(_segment("kids", "i")).alias("path"),
        sub.alias("subroot"),
    )


def _jump(nodes: DataFrame) -> DataFrame:
    """Pointers to the ancestors of the ancestors, with the segments in between."""
    far = nodes.select(
        F.col("tree").alias("up_tree"),
        F.col("level").alias("up_level"),
        F.col("idx").alias("up_idx"),
        F.struct(F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), "path", "subroot").alias("far"),
    )
    here = nodes.join(far, ["up_tree", "up_level", "up_idx"], "left")
    return here.select(
        "tree",
        "level",
        "idx",
        F.col("far.tree").alias("up_tree"),
        F.col("far.level").alias("up_level"),
        F.col("far.idx").alias("up_idx"),
        F.when(F.col("far").isNull(), F.col("path")).otherwise(F.concat("path", "far.path")).alias("path"),
        F.coalesce("subroot", "far.subroot").alias("subroot"),
    )


def _paths(below: list[DataFrame], above: list[DataFrame], top: DataFrame) -> DataFrame | None:
    """(tree, level, idx, path, subroot): segments from every inner node and lone leaf to the root."""
    child, none = F.expr(f"idx * {RUN} + i"), F.lit(None).cast("string")
    steps = [_children(t, k + 1, F.col("tree"), child, F.lit(k), none) for k, t in enumerate(below) if k]
    for k, t in enumerate(above):
        if k:
            steps.append(_children(t, k + 1, F.col("tree"), child, F.lit(k), none))
        else:
            steps.append(_children(t, 1, F.col("kid.name"), F.lit(0).cast("bigint"), F.col("kid.height"), F.col("kid.hash")))
    if not steps:
        return None
    nodes = steps[0]
    for step in steps[1:]:
        nodes = nodes.unionByName(step)
    # what points to the root has arrived: nothing is joined to the root itself
    height = len(above) or len(below)
    arrived = F.lit(True) if not above else F.col("up_tree") == TOP
    at_root = arrived & (F.col("up_level") == height)
    for c in ("up_tree", "up_level", "up_idx"):
        nodes = nodes.withColumn(f"_{c}", F.when(~at_root, F.col(c)))
    nodes = nodes.drop("up_tree", "up_level", "up_idx")
    nodes = written(nodes.withColumnsRenamed({f"_{c}": c for c in ("up_tree", "up_level", "up_idx")}), "jump_0")
    distance = 1
    while distance < len(below) + len(above):
        nodes = written(_jump(nodes), f"jump_{distance}")
        distance *= 2
    return nodes.select("tree", "level", "idx", "path", "subroot")


def proofs(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path) of every row; ``path`` holds (left, right) level by level.

    A row is a leaf, repeated rows as often as they occur. Within a source leaves ascend by
    doc_id, then by leaf; nulls come first, and rows without a source are a tree of their own.
    Null fields are written as "-", empty texts as "0:", texts of any length are hashed whole.
    Columns other than doc_id, source, lang, n_chars and text are not read. An empty table has no
    root and gives no rows; a single row is its own root and has an empty path.
    """
    placed = numbered(written(leaves(documents), "leaves"), "tree", ["doc_id", "leaf", "uid"], "placed")
    base = placed.select("tree", F.col("pos").alias("idx"), "n", F.col("leaf").alias("hash"), "doc_id", "changed")
    below = _levels(base, ["doc_id", "changed"], "level")
    roots = [t.where("n = 1").select("tree", F.lit(k).alias("height"), "hash") for k, t in enumerate([base, *below])]
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    top = numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "height", "hash"), "tree", ["name"], "top")
    top = top.withColumnRenamed("pos", "idx")
    above = _levels(top, ["name", "height"], "top_level")
    last = (above[-1] if above else top).where("n = 1").select("hash").first()
    root = F.lit(last[0] if last else None).cast("string")

    kid = F.struct(*(F.col(c) for c in ("idx", "hash", "doc_id", "changed")))
    groups = base.where("n = 1").select("tree", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("idx"), F.array(kid).alias("kids"))
    if below:
        groups = groups.unionByName(below[0].select("tree", F.lit(1).alias("level"), "idx", "kids"))
    paths = _paths(below, above, top)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    if paths is None:
        groups = groups.select("*", empty.alias("path"), F.lit(None).cast("string").alias("subroot"))
    else:
        groups = groups.join(paths, ["tree", "level", "idx"], "left")
    rows = groups.select("level", "kids", "path", "subroot", F.posexplode("kids").alias("i", "kid"))
    own = F.when(F.col("level") == 1, F.array(_segment("kids", "i"))).otherwise(empty)
    return rows.select(
        "kid.doc_id",
        F.col("kid.hash").alias("leaf"),
        "kid.changed",
        F.coalesce("subroot", root).alias("subroot"),
        root.alias("root"),
        F.concat(own, F.coalesce("path", empty)).alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(path, leaf, lambda node, beside: digest(beside["left"], node, beside["right"]))


def verified(proven: DataFrame) -> DataFrame:
    """Digests of the proofs, and what becomes of them when some rows are tampered with."""
    siblings = F.array_join(F.transform("path", lambda beside: F.concat(beside["left"], beside["right"])), "")
    result = proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(siblings).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))
