import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import catalog, jaccard, words
from tests.conftest import SF


def shingle_set(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_large_batches_are_taken_in_short_runs(monkeypatch):
    """What a step holds at once follows from the run, not from the batch; freed memory goes back."""
    given = []
    monkeypatch.setattr(words, "give_back", lambda: given.append(1))
    members = [np.arange(i % 5, i % 5 + 20, dtype=np.uint64).tobytes() for i in range(5000)]
    ids = pa.array(range(5000), pa.int64())
    batch = pa.record_batch([ids, ids, pa.array(members), pa.array([members[0]] * 5000)], names=["a", "b", "a_members", "b_members"])
    made = list(jaccard._exact(iter([batch, batch]), percent=85))
    assert max(m.num_rows for m in made) <= 1024 and len(given) == 2
    assert [x for m in made for x in m.column("a").to_pylist()] == [i for i in range(5000) if i % 5 < 2] * 2


def brute(rows, percent=85, width=4):
    """Every pair compared; (doc_id, n_shingles, component_id) sorted."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in where[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def brute_links(rows, percent=85, width=4):
    """(doc_id, number of other rows that are linked) by every pair, sorted."""
    sets = [shingle_set(t, width) for _, t in rows]
    near = lambda s, t: bool(s and t) and 100 * len(s & t) >= percent * len(s | t)
    return sorted(((d, sum(near(sets[i], s) for s in sets) - bool(sets[i])) for i, (d, _) in enumerate(rows)), key=str)


def links(df):
    return sorted(((r["doc_id"], r["n_links"]) for r in df.collect()), key=str)


def near_copies(seed, n=160):
    """Texts of all lengths with chains of edits, so that many pairs lie close to the threshold."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randint(0, 60))
    passage = [word() for _ in range(50)]
    rows = []
    for base in range(n // 8):
        text = [word() for _ in range(r.choice([1, 3, 4, 5, 8, 9, 10, 12, 20, 40, 90, 200]))]
        if base % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = passage
        for _ in range(8):
            text = list(text)
            for _ in range(r.randint(0, max(1, len(text) // 40))):
                k = r.randrange(len(text) + 1)
                text[k : k + r.randint(0, 2)] = [word()] * r.randint(0, 2)
            text = text or ["x"]
            rows.append((len(rows) * 7 % 1009, " ".join(w.upper() if r.random() < 0.1 else w for w in text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(documents, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "LISTED", 2 * seed)
    monkeypatch.setattr(jaccard, "HUBS", seed)
    rows = near_copies(seed)
    assert result(jaccard.linked(documents(rows))) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_links_against_all_pairs(documents, seed, monkeypatch):
    """Every pair counts, also in components that fewer links connect; copies and repeated rows included."""
    monkeypatch.setattr(jaccard, "COUNTED", 2 * seed)
    monkeypatch.setattr(jaccard, "SHINGLES", 1 << 6 + seed)
    rows = near_copies(seed)
    rows += rows[::9] + [(None, t) for _, t in rows[::11]] + [(5, None), (5, " ")]
    assert links(jaccard.linked(documents(rows))) == brute_links(rows)


def test_three_similar_texts_have_three_links(documents):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words, *["x", "y", "z"][:k]])) for k in range(3)]
    assert links(jaccard.linked(documents(rows))) == [(0, 2), (1, 2), (2, 2)]


@pytest.mark.parametrize("doc", [None, 7])
def test_a_set_is_fetched_by_its_own_row(documents, doc):
    """Rows without a doc_id, or with one and the same, do not meet every set."""
    texts = [f"word number {k} of many" for k in range(30)]
    d = jaccard.texts(documents([(doc, t) for t in texts])).withColumn("text_hash", F.xxhash64("text"))
    summary = d.withColumn("set_id", F.col("text_hash"))
    rows = jaccard._first_texts(d, summary, summary.select("set_id")).collect()
    assert len(rows) == 30 and {r["text"] for r in rows} == set(texts)


def test_edge_rows(documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(4, None), (3, ""), (2, " \n"), (None, "a b c d e"), (9, "A B c d e"), (8, "a b\x0bc\x0cd\te"), (8, "other words of the same id"), (8, "a b c d e"), (7, "one"), (6, "ONE"), (20, "É b"), (21, "é b"), (11, long), (10, long + " x"), (None, "alone here")]
    got = result(jaccard.linked(documents(rows)))
    want = [(d, n, d if c is None else c) for d, n, c in brute(rows)]
    assert got == sorted(want, key=str)


def test_empty_table(documents):
    assert jaccard.linked(documents([])).count() == 0


def test_similar_sets_share_a_key():
    """Also for sets at the border, of sizes where parts are often empty."""
    tiles, r = jaccard.Tiles(85), np.random.default_rng(5)
    for _ in range(4000):
        n = int(r.choice([6, 7, 8, 9, 12, 14, 20, 33, 70, 150, 400]))
        h = np.unique(r.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64) * np.uint64(2))
        r.shuffle(h)
        both = int(r.integers(n - n // 6, n + 1))
        a, b = h[:n], np.concatenate((h[:both], h[n : n + int(r.integers(0, n // 6 + 2))]))
        if len(b) and jaccard.similar(both, len(a), len(b), 85) and not (len(b) == both == n):
            assert np.intersect1d(tiles.keys(np.sort(a)), tiles.keys(np.sort(b))).size


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(6)
    for n in (1, 50, 64, 65, 3000, 20_000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[: n // 2], r.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64))))
        a, b = jaccard.bitmap(x), jaccard.bitmap(y)
        words = min(len(a), len(b))
        assert jaccard.most_common(jaccard.folded(a, words), len(x), jaccard.folded(b, words), len(y)) >= len(np.intersect1d(x, y))


def test_query_over_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(catalog.op1_ngram_jaccard(spark, SF)) == brute(rows)
