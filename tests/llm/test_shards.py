import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandline.llm import catalog, shards, tokens
from tests.conftest import SF

PATH = tokens.public_path()
WHOLE = Tokenizer.from_file(PATH)


def plain(rows):
    """(doc_id, start, n_tokens, crc) by one pass in order."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


CASES = [(9, "hello"), (1, None), (5, ""), (5, "twice"), (5, "twice"), (None, "no key"), (None, None), (-3, "long " * 50_000), *[(100 + i, f"doc {i} ümläut") for i in range(500)]]


def test_round_trip_by_key(documents, spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 2000)
    monkeypatch.setattr(shards, "BUCKET_KEYS", 60)
    d = documents(CASES)
    folder = shards.write_corpus(d, PATH)
    rows = shards.read_corpus(spark, folder, shards.keys_of(d)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows], key=key) == plain(CASES)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    some = spark.createDataFrame([(120, 0), (99_999, 0), (5, 2), (5, 3)], "doc_id long, nth long")
    assert sorted(r[0] for r in shards.read_corpus(spark, folder, some).collect()) == [5, 120]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    slots = shards.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_empty_table(documents, spark):
    d = documents([])
    assert shards.read_corpus(spark, shards.write_corpus(d, PATH), shards.keys_of(d)).count() == 0


def test_query_over_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in catalog.op2_token_shards(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == plain(rows)
