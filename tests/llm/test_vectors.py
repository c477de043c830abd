import numpy as np
import pytest

from strandline.llm import catalog, vectors
from tests.conftest import SF


def brute(rows, cosine=0.9):
    good = []
    for i, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        good.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = good[i], good[j]
            if a is None or b is None or len(a) != len(b):
                continue
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, links[i], least.get(find(i)), None if k is None or find(i) not in least else k == least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows, kind="float"):
    rows = [(k, v, 0, "x") for k, v in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, class_id string").repartition(3)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 16)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    r = np.random.default_rng(4)
    rows = []
    for c in r.normal(size=(25, 16)):
        for _ in range(12):
            v = c * r.choice([1.0, 3.0]) + r.normal(size=16) * r.choice([0.0, 0.2, 0.35, 0.6])
            rows.append((len(rows) * 7 % 1009, [float(np.float32(x)) for x in v]))
    want = brute(rows)
    got = result(vectors.near_duplicates(table(spark, rows, kind), recall=0.9999))
    assert got == want


def test_edge_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0])]
    rows += [(7, [1.0, 0.0]), (8, [1e-30, 0.0]), (8, [0.0, 1.0]), (9, [-0.0, 5.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (12, [3e38, 1e37]), (7, [1.0, 0.0]), (None, None)]
    got = result(vectors.near_duplicates(table(spark, rows)))
    assert got == brute(rows)
    assert vectors.near_duplicates(table(spark, [])).count() == 0


def test_recall_over_the_given_table(spark):
    folder = SF.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    want = dict(zip([r["vec_id"] for r in rows], (x @ x.T >= 0.9).sum(1) - 1, strict=True))
    got = {r["vec_id"]: r["n_links"] for r in catalog.op6_embedding_near_dedup(spark, folder).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_tables_grow_with_the_vectors():
    assert [vectors.tables(n)[0] for n in (0, 100, 51_282, 10**9)] == [4, 4, 9, 23]
