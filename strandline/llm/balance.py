"""Sharding by balanced label propagation: linked documents gather in one shard, counts stay even.

Documents start in shards in turn. Links join documents of equal text (or of any other mark);
documents of a mark in one shard have the same neighbours, so they move as a block of (mark,
shard, rows). In every round each mark votes, by its rows, for a shard; the blocks elsewhere are
joined to the winner and ask to follow. The quota of a pair of shards is what comes back the
other way and what room the target has left for linked documents. Requests are admitted in order
of their votes, by the sums of a few thousand classes; only the class in which a quota ends is
sorted, and a block may be split there, so quotas are met exactly. Every admitted row adds links
inside shards, so the rounds end by themselves. Documents without links then fill every shard up
to its share.

A mark with a third of all rows is one row for each shard while the rounds last. Rows get their
shard from their number within the mark, counted over sorted ranges, not in one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.ranks import numbered
from strandline.llm.store import written

SHARDS = 16
LAW = "rows"
#: Classes of requests: 64 by the logarithm of the votes, each cut in 64 by hash.
CUTS = 64


def _at(values: list[int], shard: str) -> Column:
    """The number of a shard, from one number a shard."""
    return F.element_at(F.array(*(F.lit(int(v)).cast("bigint") for v in values)), F.col(shard) + 1)


def _loads(blocks: DataFrame, shards: int) -> list[int]:
    found = dict(blocks.groupBy("shard").agg(F.sum("rows")).collect())
    return [found.get(s, 0) for s in range(shards)]


def _start(rows: DataFrame, shards: int) -> DataFrame:
    """(mark, shard, rows) of marks with several rows, rows dealt to shards in turn.

    The window without a key is over one row for each written part.
    """
    part, place = F.shiftright("uid", 33), F.col("uid").bitwiseAND((1 << 33) - 1)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    dealt = rows.select("mark", part.alias("part"), place.alias("place")).join(parts, "part")
    blocks = dealt.groupBy("mark", ((F.col("place") + F.col("before")) % shards).cast("int").alias("shard")).agg(F.count("*").alias("rows"))
    return blocks.withColumn("all", F.sum("rows").over(Window.partitionBy("mark"))).where(F.col("all") > 1).drop("all")


def _requests(blocks: DataFrame, room: list[int] | None, turn: int) -> DataFrame:
    """(mark, shard, rows, target, class): blocks that would join the most of their mark.

    With ``room``, only shards that have some are voted for.
    """
    votes = F.struct("rows", F.xxhash64("mark", "shard").alias("tie"), "shard")
    open_to = blocks if room is None else blocks.where(_at(room, "shard") > 0)
    winner = open_to.groupBy("mark").agg(F.max(votes).alias("best"))
    # a mark has one winner a turn, so with equal votes a move brings more together than it parts
    follows = blocks.join(winner, "mark").where((F.col("best.shard") != F.col("shard")) & (F.col("best.rows") >= F.col("rows")))
    rank = 63 - F.floor(F.log2(F.col("best.rows").cast("double")))
    cut = F.pmod(F.xxhash64("mark", F.lit(turn)), F.lit(CUTS))
    return follows.select("mark", "shard", "rows", F.col("best.shard").alias("target"), (rank * CUTS + cut).cast("bigint").alias("class"))


def quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may go from shard to shard: as many as come back, and what the target has room for."""
    room, out = list(room), {}
    for (a, b), rows in sorted(asked.items()):
        back = min(rows, asked.get((b, a), 0))
        more = min(rows - back, room[b])
        room[b] -= more
        if back + more:
            out[a, b] = back + more
    return out


def _allowed(requests: DataFrame, room: list[int]) -> dict[tuple[int, int], int]:
    pairs = requests.groupBy("shard", "target").agg(F.sum("rows").alias("rows")).collect()  # shards x shards
    return quotas({(r["shard"], r["target"]): r["rows"] for r in pairs}, room)


def _admitted(requests: DataFrame, allowed: dict[tuple[int, int], int], shards: int) -> DataFrame:
    """``requests`` with ``moved``: for each pair of shards the quota's rows exactly, first classes first."""
    pair = ["shard", "target"]
    table = F.array(*(F.lit(allowed.get((a, b), 0)).cast("bigint") for a in range(shards) for b in range(shards)))
    quota = F.element_at(table, F.col("shard") * shards + F.col("target") + 1)
    classes = requests.groupBy(*pair, "class").agg(F.sum("rows").alias("here"))
    up_to = F.sum("here").over(Window.partitionBy(*pair).orderBy("class"))
    classes = classes.withColumn("left", quota - up_to + F.col("here"))
    # one row a pair at most: the class in which its quota ends
    last = classes.where("left >= 0 and left < here").select(*pair, F.col("class").alias("last"), "left")
    asked = requests.join(F.broadcast(last), pair, "left")
    whole = asked.where((F.col("last").isNull() & (quota > 0)) | (F.col("class") < F.col("last"))).withColumn("moved", F.col("rows"))
    before = F.sum("rows").over(Window.partitionBy(*pair).orderBy("mark")) - F.col("rows")
    ending = asked.where("class = last").withColumn("before", before)
    ending = ending.withColumn("moved", F.least("rows", F.col("left") - F.col("before"))).where("moved > 0")
    names = ["mark", "shard", "rows", "target", "class", "moved"]
    return whole.select(*names).unionByName(ending.select(*names))


def _gathered(blocks: DataFrame, room: list[int], turn: int) -> DataFrame:
    """Requests of whole marks for a shard with room for all of them: only classes that fit whole are admitted."""
    shards = F.array(*(F.lit(s) for s in range(len(room))))
    rooms = F.array(*(F.lit(r).cast("bigint") for r in room))
    parted = blocks.groupBy("mark").agg(F.sum("rows").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    parted = parted.withColumn("fits", F.filter(shards, lambda s: F.element_at(rooms, s + 1) >= F.col("all"))).where("size(fits) > 0")
    turned = F.pmod(F.xxhash64("mark", F.lit(turn)), F.size("fits")).cast("int")
    rank = 63 - F.floor(F.log2(F.col("all").cast("double")))
    cut = F.pmod(F.xxhash64(F.lit(turn), "mark"), F.lit(CUTS))
    parted = parted.select("mark", F.element_at("fits", turned + 1).alias("target"), (rank * CUTS + cut).cast("bigint").alias("class"))
    asked = blocks.join(parted, "mark").where("shard <> target")
    up_to = F.sum("here").over(Window.partitionBy("target").orderBy("class"))
    classes = asked.groupBy("target", "class").agg(F.sum("rows").alias("here")).withColumn("up_to", up_to)
    # at most shards x 64 x CUTS rows
    admitted = classes.where(F.col("up_to") <= _at(room, "target")).select("target", "class")
    return asked.join(F.broadcast(admitted), ["target", "class"]).withColumn("moved", F.col("rows"))


def _propagated(blocks: DataFrame, shares: list[int]) -> tuple[DataFrame, list[int]]:
    """Blocks when all marks are whole or nothing is admitted any more, and the linked rows of each shard.

    Turns with votes for any shard, which mostly swap, and for shards with room alternate. When
    both end, marks that are still parted may go where all their rows have room.
    """
    load, turn, idle = _loads(blocks, len(shares)), 0, 0
    while idle < 4 and not blocks.groupBy("mark").count().where("count > 1").isEmpty():
        room = [share - x for share, x in zip(shares, load, strict=True)]
        if idle < 2:
            asked = written(_requests(blocks, room if turn % 2 else None, turn), "requests")
            allowed = _allowed(asked, room)
            moves = _admitted(asked, allowed, len(shares))
        else:
            moves = written(_gathered(blocks, room, turn), "requests")
            gone = moves.groupBy("shard", "target").agg(F.sum("moved").alias("rows")).collect()  # shards x shards
            allowed = {(r["shard"], r["target"]): r["rows"] for r in gone}
        turn += 1
        if not allowed:
            idle += 1
            continue
        idle = 0
        for (a, b), rows in allowed.items():
            load[a] -= rows
            load[b] += rows
        ends = F.array(F.struct("shard", (-F.col("moved")).alias("rows")), F.struct(F.col("target").alias("shard"), F.col("moved").alias("rows")))
        blocks = blocks.unionByName(moves.select("mark", F.inline(ends)))
        blocks = written(blocks.groupBy("mark", "shard").agg(F.sum("rows").alias("rows")).where("rows > 0"), "blocks")
    return blocks, load


def sharded(documents: DataFrame, shards: int = SHARDS, mark: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Shards hold equally many rows, at most one apart. Rows of equal ``mark`` (default: the text)
    are linked; a mark that fits goes to one shard, a larger one to few. ``slot`` numbers the
    rows of a shard without gaps, linked rows first. ``size`` is the text's UTF-8 bytes plus one;
    a null text has no bytes and counts as equal to an empty one, a null ``mark`` links nothing.
    Texts of any length are read whole, and only once. Null and repeated doc_ids and repeated
    rows are rows like any other, and columns but doc_id, text and those of ``mark`` are not
    read. An empty table gives no rows. Ties of votes go by hash of (mark, shard).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.md5(text.cast("binary")) if mark is None else mark.cast("string")).alias("mark"),
        F.monotonically_increasing_id().alias("uid"),
    )
    if mark is not None:
        rows = rows.withColumn("mark", F.coalesce(F.concat(F.lit("="), "mark"), F.col("uid").cast("string")))
    rows = written(rows, "rows")
    total = rows.count()
    shares = [total // shards + (s < total % shards) for s in range(shards)]
    blocks, load = _propagated(written(_start(rows, shards), "blocks"), shares)

    placed = numbered(rows, "mark", ["uid"], "by_mark")
    names = ["doc_id", "size", "text_crc32", "uid"]
    first = Window.partitionBy("mark").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.withColumn("first", F.coalesce(F.sum("rows").over(first), F.lit(0)))
    ranges = ranges.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("ranges"))
    # one row a mark on the right: a hot mark's rows on the left are split by adaptive execution
    linked = placed.where("n > 1").join(ranges, "mark")
    linked = linked.withColumn("shard", F.expr("element_at(filter(ranges, r -> r.first <= pos), -1).shard"))
    linked = numbered(linked.select("shard", *names), "shard", ["uid"], "linked").withColumnRenamed("pos", "slot")
    alone = numbered(placed.where("n = 1").select(F.lit(0).alias("all"), *names), "all", ["uid"], "alone")
    ends = list(accumulate(share - x for share, x in zip(shares, load, strict=True)))
    into = F.size(F.filter(F.array(*(F.lit(e).cast("bigint") for e in ends)), lambda e: e <= F.col("pos")))
    alone = alone.withColumn("shard", into.cast("int"))
    shift = [x - (ends[s - 1] if s else 0) for s, x in enumerate(load)]
    alone = alone.withColumn("slot", F.col("pos") + _at(shift, "shard"))
    out = ["doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return linked.select(*out).unionByName(alone.select(*out))
