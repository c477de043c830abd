import random

import pytest

from strandline.llm.components import components, roots, stars


def plain(links):
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in root}


def graphs():
    r = random.Random(3)
    yield "long path", [(i, i + 1) for i in range(60)]
    yield "star with loops and nulls", [(7, i) for i in range(40)] + [(5, 5), (None, 3), (90, 90)]
    yield "random", [(r.randint(-80, 80), r.randint(-80, 80)) for _ in range(70)]
    yield "empty", []


@pytest.mark.parametrize("name,links", list(graphs()))
def test_roots(spark, name, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["v"]: r["root"] for r in components(df).collect()}
    assert got == plain(links)
    some = {r["v"]: r["root"] for r in roots(stars(df, 1)).collect()}
    assert set(some) == set(got) and all(got[root] == got[v] and root <= v for v, root in some.items())


def test_a_round_looks_at_its_links_four_times(spark):
    """Each star step takes the smallest neighbour and joins it back; more looks swell the driver's plans."""
    from strandline.llm.components import _star

    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "a long, b long")
    round_ = _star(_star(edges, True), False)
    assert round_._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4
    assert sorted(map(tuple, round_.distinct().collect())) == [(2, 1), (3, 1), (5, 4)]
