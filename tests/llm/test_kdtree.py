import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from strandline.llm import catalog, kdtree
from tests.conftest import SF


def brute(rows, top=5, every=50):
    good = [(i, [math.floor(256 * Fraction(c)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        found = [(-min((1 << 63) - 1, max(-(1 << 63), sum(a * b for a, b in zip(x, y)))), j) for i, x in good if i == q for j, y in good if j != q]
        out += [(q, k + 1, j, -s) for k, (s, j) in enumerate(sorted(found)[:top])]
    return out


def result(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, None) for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 60)
    monkeypatch.setattr(kdtree, "QUERIES", 3)
    monkeypatch.setattr(kdtree, "LEAF", 4)
    r = np.random.default_rng(seed)
    x = r.normal(size=(400, 6)) if seed == 1 else r.integers(-2, 3, size=(400, 6)) / 256  # many ties
    rows = list(enumerate(x.tolist()))
    assert result(kdtree.top_k(table(spark, rows))) == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (100, [nan, 1.0]), (150, None), (200, []), (1, [inf]), (2, [None, 1.0]), (3, [0.5, 0.5, 9.0]), (3, [0.5, 0.5, 9.0]), (4, [2.0, 1.0]), (0, [5.0, -1.0]), (None, [1.0, 1.0]), (250, [1.0, 1.0])]
    assert result(kdtree.top_k(table(spark, rows))) == brute(rows)
    big = [(0, [1e9, -1e9]), (1, [1e9, 1.0]), (2, [1e30, 0.0]), (3, [0.001, 0.5]), (50, [1.0, 1.0]), (4, [1e308, 1.0]), (100, [-1e308, 0.5])]
    assert result(kdtree.top_k(table(spark, big))) == brute(big)
    assert kdtree.top_k(table(spark, [])).count() == 0


def test_repeated_rows_hold_their_ranks(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 30)
    monkeypatch.setattr(kdtree, "LEAF", 4)
    r = np.random.default_rng(5)
    x = (r.integers(-3, 4, size=(120, 3)) / 256).tolist()
    rows = list(enumerate(x))
    rows += [rows[50], rows[50], rows[7], *[rows[9]] * 8, (7, x[8]), (3, [5000.0, 1.0, -1.0]), (3, [5000.0, 1.0, -1.0])]
    assert result(kdtree.top_k(table(spark, rows))) == brute(rows)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [list(row) for row in rows])
    assert sorted(con.execute(catalog.ORACLES["op10_exact_top_k"]).fetchall()) == brute(rows)


def test_boxes_are_tight_and_prune():
    r = np.random.default_rng(0)
    x = np.floor(256 * (r.normal(size=(40, 8))[r.integers(0, 40, 4000)] + 0.02 * r.normal(size=(4000, 8))))
    tree = kdtree.Tree(x)
    for (a, b), low, high in zip(tree.span, tree.low, tree.high, strict=True):
        assert (tree.rows[a:b].min(0) == low).all() and (tree.rows[a:b].max(0) == high).all()
    found, read = kdtree.search(tree, np.arange(4000), x[:20], np.arange(20), np.full(20, -np.inf), 5)
    leaves = sum(c is None for c in tree.children)
    assert len(found) == 100 and read < 0.5 * 20 * leaves
    kth = [min(s for k, s, _ in found if k == i) for i in range(20)]
    again, fewer = kdtree.search(tree, np.arange(4000), x[:20], np.arange(20), np.array(kth, float), 5)
    assert sorted(again) == sorted(found) and fewer <= read


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(catalog.ORACLES["op10_exact_top_k"]).fetchall()
    got = catalog.op10_exact_top_k(spark, SF)
    assert result(got.select("query_id", "rank", "vec_id", "score")) == sorted(want)
