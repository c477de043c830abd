import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from strandline.llm import packing, tokens
from tests.conftest import SF

PATH = tokens.public_path()
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


TEXT = st.text(st.sampled_from("aBzé'sS \t\n\x0b\x0c\r\x1c\x1f\x85\xa0  !?.,123ßΣςİıé̈Ａ中😀<|endoftext|>") | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.none() | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "don't'll", ""]), max_size=8))
def test_ids_by_word_are_the_ids_of_the_text(rows):
    encoder = tokens.encoder(PATH)
    got = []
    for _, ids, offsets in encoder.encode(pa.array(rows, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [ids_of(t) for t in rows]


def test_ids_when_the_table_of_words_is_emptied(spark):
    rows = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = []
    for _, ids, offsets in tokens.Encoder(PATH, known=1000).encode(pa.array(rows)):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [ids_of(t) for t in rows]


def one_by_one(histogram, cap):
    """Sequences that best fit decreasing opens when it places every piece on its own."""
    space = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            k = bisect.bisect_left(space, n)
            bisect.insort(space, (space.pop(k) if k < len(space) else cap) - n)
    return len(space)


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_sequences(seed):
    r = random.Random(seed)
    cap = r.choice([7, 64, 2048])
    histogram = {n: r.randint(1, 500) for n in r.sample(range(1, cap + 1), min(cap, 60))}
    seen, rows = {n: [] for n in histogram}, []
    for n, r0, r1, first, each, at in packing.plan(histogram, cap):
        seen[n] += range(r0, r1)
        rows += [(first + (x - r0) // each, at + (x - r0) % each * n, n) for x in range(r0, r1)]
    assert all(sorted(seen[n]) == list(range(k)) for n, k in histogram.items())
    assert packing.check_places(rows, cap)
    assert len({s for s, *_ in rows}) == one_by_one(histogram, cap) >= packing.lower_bound(histogram, cap)


CASES = [(1, "hello world"), (2, None), (3, ""), (4, "long words here " * 3000), (5, "hello world"), (5, "hello world"), (None, "no key"), (6, " \n\t "), *[(100 + i, "same text") for i in range(200)]]


def test_pack_whole_documents(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 16)
    packed = packing.pack(documents(CASES), PATH)
    rows = packed.collect()
    docs = {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["piece"]), []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in CASES:
        want = [*ids_of(text), 0]
        for k, a in enumerate(range(0, len(want), 2048)):
            piece = docs[i, k].pop()
            assert (piece["start"], np.frombuffer(piece["ids"], "<u4").tolist()) == (a, want[a : a + 2048])
    assert not any(docs.values())
    assert packing.check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert all(len(s["ids"]) == 4 * s["length"] <= 4 * 2048 for s in whole.values())
    for r in rows:
        assert whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


def test_pack_nothing(documents):
    assert packing.pack(documents([]), PATH).count() == 0
