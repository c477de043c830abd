import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, n int, terms string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    size, words = len(counts), sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        scores = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * size) // words
            s = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * size + 2) / (2 * holding[t] + 1)))
                s += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return out


def same(spark, documents, docs, items):
    asked = spark.createDataFrame([(*x, 5, 6, "z") for x in items], ITEMS)
    got = [tuple(r) for r in lexical.ranked(documents(docs), asked).collect()]
    return sorted(map(repr, got)) == sorted(map(repr, brute(docs, items)))


def sample(rng, n):
    words = [f"w{int(40 * rng.random() ** 3)}" for _ in range(n)]
    return rng.choice([" ", ", ", "\n"]).join(words)


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 16])
def test_against_all_documents(spark, documents, monkeypatch, block):
    """Copies, ties, nulls, long texts, repeated items; also with many blocks of items."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 64)
    rng = random.Random(5)
    docs = [(i, sample(rng, rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 Ä1 W3") for i in range(60)] + [(7, "w1 w2")] * 5 + [(None, "w9 w8 w7"), (None, None)]
    docs += [(2000, ""), (2001, "--- !"), (2002, "w5 " * 50_000), (2003, "Ä1 ä1 w39")]
    items = [(k, sample(rng, 12)) for k in range(8)] + [(3, "w1 w1 Ä1"), (4, None), (5, ""), (6, "nowhere"), (None, "w2 w39"), (9, "w3"), (9, "w3")]
    assert same(spark, documents, docs, items)


def test_empty_tables(spark, documents):
    assert same(spark, documents, [], [(1, "a")])
    assert same(spark, documents, [(1, "a")], [])
    assert same(spark, documents, [(1, None)], [(1, "a")])


def test_masks_group_documents_and_bounds_skip_some():
    """Documents that hold the same terms share a mask; a mask below the kept scores is not scored."""
    gains = np.array([[5, 0, 5, 0, 1], [0, 7, 0, 7, 1]], np.int64)
    present = np.packbits(gains > 0, axis=1, bitorder="little")
    item = lexical.Item(np.array([0, 1]), np.array([10, 1], np.int64))
    mask, group = item.masks(present)
    assert len(set(group[:5])) == 3 and group[0] == group[2] and group[1] == group[3]
    kept = [(90, False, 1), (60, False, 2)]
    assert item.search(present, gains, [3, 4, 5, 6, 7], kept, 2) == kept
    assert item.search(present, gains, [3, 4, 5, 6, 7], [], 2) == [(50, False, 3), (50, False, 5)]
