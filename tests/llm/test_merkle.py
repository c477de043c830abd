import hashlib
import random
import zlib

from strandline.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, leaf string, n int, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, source, lang, n_chars = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Root of a list of digests and the (left, right) siblings of each on its way."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(place):
            a = i // 16 * 16
            paths[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
            place[k] = i // 16
        nodes = [sha("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
    return (nodes[0] if nodes else None), paths


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[2], []).append(r)
    trees = []
    for s in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *climb([leaf(r, r[1]) for r in own])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, paths), rest in zip(trees, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            path, node = path + rest, leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                node = sha(a + node + b)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def same(spark, rows):
    table = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in merkle.verified(merkle.proofs(table)).collect()]
    return sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_sources_of_all_sizes_with_nulls_copies_and_long_texts(spark):
    rng = random.Random(3)
    rows = [(i, "Ab c %d" % i, "hot", "en", 3) for i in range(300)]
    rows += [(7, "Same row", "hot", "en", 3)] * 40
    rows += [(i, rng.choice(["", None, "ÄÖ Z", "Word " * 40_000]), f"s{i}", None, None) for i in range(20)]
    rows += [(None, rng.choice(["A", "b"]), rng.choice([None, "", "=", "top"]), "en", i % 3) for i in range(60)]
    rng.shuffle(rows)
    assert same(spark, rows)


def test_one_row_one_source_and_one_run(spark):
    assert same(spark, [(5, "Only Row", None, "en", 1)])
    assert same(spark, [(i, f"T{i}", "a", "en", 1) for i in range(17)])
    assert same(spark, [(i, f"T{i}", f"s{i:02}", "en", 1) for i in range(17)])


def test_empty_table(spark):
    assert same(spark, [])


def test_a_row_in_another_place_changes_the_root(spark):
    rows = [(i, f"T{i}", "a", "en", 1) for i in range(20)]
    roots = set()
    for change in (rows, rows[:-1], [*rows[:-1], (19, "t19", "a", "en", 1)]):
        roots.add(brute(change)[0][3])
    assert len(roots) == 3


def test_paths_lead_from_leaf_to_root(spark):
    rows = [(i, f"T{i}", f"s{i % 3}", "en", 1) for i in range(200)]
    table = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA)
    for r in merkle.proofs(table).collect():
        node = r.leaf
        for beside in r.path:
            node = sha(beside.left + node + beside.right)
        assert node == r.root
