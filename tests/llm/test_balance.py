import itertools
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from strandline.llm import balance


def checked(documents, rows, shards=4, **options):
    """The shards of the rows, after a check of everything that holds for any table."""
    got = balance.sharded(documents(rows), shards, **options).collect()
    want = sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    counts = Counter(r.shard for r in got)
    sizes = [counts[s] for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    return got


def spread(got):
    """For each text, its rows by shard, largest first."""
    by = {}
    for r in got:
        by.setdefault(r.text_crc32, Counter())[r.shard] += 1
    return {k: sorted(c.values(), reverse=True) for k, c in by.items()}


def inside(parts):
    return sum(n * (n - 1) // 2 for counts in parts for n in counts)


def best_inside(groups, shares):
    """Most links inside shards that any split of the groups reaches: every split tried."""

    def splits(n, k):
        return [c for c in itertools.product(range(n + 1), repeat=k) if sum(c) == n]

    best = {tuple(0 for _ in shares): 0}
    for n in groups:
        after = {}
        for load, links in best.items():
            for c in splits(n, len(shares)):
                new = tuple(a + b for a, b in zip(load, c, strict=True))
                if all(a <= s for a, s in zip(new, shares, strict=True)):
                    after[new] = max(after.get(new, -1), links + inside([c]))
        best = after
    return max(best.values())


def test_groups_that_fit_stay_whole(documents):
    rng = random.Random(2)
    rows = [(i, f"alone {i}") for i in range(200)]
    for k in range(40):
        rows += [(1000 + k, f"copy {k}")] * rng.randrange(2, 9)
    rng.shuffle(rows)
    parts = spread(checked(documents, rows, 7))
    assert all(len(p) == 1 for p in parts.values())


def test_against_every_split(documents):
    """With room for half as many rows again, no split of the groups keeps more links; with less, rounds end in a local best."""
    for groups, alone in (((4, 3, 2), 6), ((2, 2, 2, 2), 4), ((5, 5), 2)):
        rows = [(10 * g + i, f"copy {g}") for g, n in enumerate(groups) for i in range(n)] + [(500 + i, f"alone {i}") for i in range(alone)]
        share, rest = divmod(len(rows), 3)
        got = inside(spread(checked(documents, rows, 3)).values())
        best = best_inside(groups, [share + (s < rest) for s in range(3)])
        assert got == best if 3 * sum(groups) <= 2 * len(rows) else 2 * got >= best, groups


def test_a_third_of_all_rows_fills_few_shards(documents):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"alone {i}") for i in range(700)] + [(2000 + i // 2, f"two {i // 2}") for i in range(100)]
    parts = spread(checked(documents, rows, 12))
    hot = parts.pop(zlib.crc32(b"hot"))
    assert len(hot) <= 5 and sum(hot[:4]) >= 360
    assert all(len(p) == 1 for p in parts.values())


def test_only_copies_and_many_groups_for_little_room(documents):
    assert len(checked(documents, [(3, "same")] * 41, 4)) == 41
    rng = random.Random(4)
    rows = [(i, f"copy {int(30 * rng.random() ** 2)}") for i in range(301)]
    parts = spread(checked(documents, rows, 5))
    dealt = [list(Counter(i % 5 for i in range(sum(p))).values()) for p in parts.values()]
    assert inside(parts.values()) > 2 * inside(dealt)


def test_nulls_long_texts_and_other_marks(documents):
    rows = [(None, None), (None, ""), (1, None), (1, "ä"), (1, "ä"), (2, "long " * 60_000), (None, "x")]
    checked(documents, rows, 4)
    assert checked(documents, [], 4) == []
    assert len(checked(documents, [(1, "a")], 4)) == 1
    rows = [(i, f"text {i}") for i in range(60)] + [(None, "no id")] * 4
    got = checked(documents, rows, 4, mark=F.when(F.col("doc_id") < 30, F.col("doc_id") % 3))
    for k in range(3):
        assert len({r.shard for r in got if r.doc_id is not None and r.doc_id < 30 and r.doc_id % 3 == k}) == 1


def test_requests_meet_their_quotas(spark):
    rng = random.Random(1)
    rows = [(str(k), rng.randrange(4), rng.randrange(1, 40), rng.randrange(4), rng.randrange(6)) for k in range(300)]
    rows = [r for r in rows if r[1] != r[3]]
    asked = Counter()
    for _, a, n, b, _ in rows:
        asked[a, b] += n
    room = [100, 0, 10**6, 5]
    allowed = balance.quotas(asked, room)
    for b in range(4):
        comes, goes = (sum(n for k, n in allowed.items() if k[side] == b) for side in (1, 0))
        assert comes - goes <= room[b]
    requests = spark.createDataFrame(rows, "mark string, shard int, rows long, target int, class long")
    moved, last = Counter(), {}
    for r in balance._admitted(requests, allowed, 4).collect():
        assert 0 < r.moved <= r.rows
        moved[r.shard, r.target] += r.moved
        last[r.shard, r.target] = max(last.get((r.shard, r.target), 0), r["class"])
    assert dict(moved) == allowed
    for _, a, n, b, c in rows:
        if c < last.get((a, b), 0):
            asked[a, b] -= n
    assert all(asked[k] >= 0 for k in allowed)
