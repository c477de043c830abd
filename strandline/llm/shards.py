"""Token ids in raw shard files, found by key through a minimal perfect hash index.

A corpus folder holds

* payload files: the ids of consecutive documents end to end, little-endian unsigned integers
  of 2 bytes if the vocabulary fits, else of 4; nothing else;
* ``documents``: one row per document in a payload file (shard, file, key, place, length);
  a payload file counts only if rows of this committed table name it, so files of failed or
  repeated tasks are never read;
* ``shards``: the number of ids before each shard, in order of doc_id;
* ``index``: one row per hash bucket of keys: a minimal perfect hash over levels of bit
  vectors, and in each slot a 32-bit fingerprint and the place of the document.

A lookup hashes the key, takes its bucket, tests a few bits, counts ones, compares the
fingerprint and reads one stretch of one file: constant time, without any stored key.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm.store import texts
from strandline.llm.tokens import documents_ids, public_path, release
from strandline.llm.words import mix
from strandline.session import shared_dir

END = 2
#: Text bytes of a shard, keys of an index bucket, bytes that a reader takes from a file at once.
SHARD_BYTES = 32 << 20
BUCKET_KEYS = 50_000
READ_BYTES = 8 << 20
#: Positions per key in a level of the hash: fewer make a smaller index, more fewer levels.
GAMMA = 2.0


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class PerfectHash:
    """Minimal perfect hash: keys alone on their position of a level get its bit, others go on."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.cumsum(sizes) - sizes
        self.ones = np.cumsum(bits, dtype=np.int64)

    @staticmethod
    def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct unsigned 64-bit keys."""
        sizes, bits = [], []
        while len(keys):
            size = max(1, int(GAMMA * len(keys)))
            at = cls._position(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or the slot of another key for one that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist(), strict=True)):
            at = start + self._position(keys[rest], level, size)
            hit = self.bits[at]
            out[rest[hit]] = self.ones[at[hit]] - 1
            rest = rest[~hit]
        return out


def _key_hash() -> F.Column:
    """64 bits of (doc_id, how many earlier rows had it); a null doc_id is a key of its own."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("nth").cast("long"))


def _write(parts: Iterator[pa.RecordBatch], folder: str, path: str, end: int, kind: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    file, out, at, last, nth = f"payload-{shard:06d}-{uuid.uuid4().hex}.ids", None, 0, object(), 0
    for part in parts:
        keys = part.column("doc_id").to_pylist()
        rows = []
        for key, ids in zip(keys, documents_ids(part.column("text"), path, end), strict=True):
            if out is None:
                fs, base = _file_system(folder)
                fs.create_dir(base)
                out = fs.open_output_stream(f"{base}/{file}")
            nth = nth + 1 if key == last else 0
            last = key
            out.write(ids.astype(kind).tobytes())
            rows.append((key, nth, at, len(ids)))
            at += len(ids)
        if rows:
            k, n, a, c = zip(*rows, strict=True)
            size = len(rows)
            columns = [pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array([shard] * size, pa.int32()), pa.array([file] * size), pa.array(a, pa.int64()), pa.array(c, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "nth", "shard", "file", "place", "n_tokens"])
    if out is not None:
        out.close()
    release(path)


PLACES = "doc_id long, nth long, shard int, file string, place long, n_tokens long"


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    hashed = PerfectHash.build(keys)
    order = np.argsort(hashed.slots(keys))
    files, which = np.unique(rows["file"].to_numpy(str), return_inverse=True)
    slots = {"fingerprint": _fingerprint(keys).astype("<u4"), "file": which.astype("<i4"), "shard": rows["shard"].to_numpy("<i4"), "place": rows["place"].to_numpy("<i8"), "n_tokens": rows["n_tokens"].to_numpy("<i8")}
    row = {"bucket": rows["bucket"].iloc[0], "sizes": hashed.sizes.astype("<i8").tobytes(), "bits": np.packbits(hashed.bits).tobytes(), "files": list(files)}
    return pd.DataFrame([row | {f"slot_{k}": x[order].tobytes() for k, x in slots.items()}])


INDEX = "bucket long, sizes binary, bits binary, files array<string>, slot_fingerprint binary, slot_file binary, slot_shard binary, slot_place binary, slot_n_tokens binary"


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)


def _lookup(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(index):
        empty = {c: np.zeros(0, np.int64) for c in ("doc_id", "nth", "shard", "place", "n_tokens")}
        return pd.DataFrame(empty | {"no_id": np.zeros(0, bool), "file": np.zeros(0, object)})
    row = index.iloc[0]
    sizes = np.frombuffer(row["sizes"], "<i8")
    hashed = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool))
    k = keys["key"].to_numpy(np.int64).view(np.uint64)
    slot = hashed.slots(k)
    known = slot >= 0
    known[known] = np.frombuffer(row["slot_fingerprint"], "<u4")[slot[known]] == _fingerprint(k[known])
    slot, found = slot[known], keys[known]
    take = {c: np.frombuffer(row[f"slot_{c}"], t)[slot] for c, t in (("shard", "<i4"), ("file", "<i4"), ("place", "<i8"), ("n_tokens", "<i8"))}
    return pd.DataFrame({"doc_id": found["doc_id"].to_numpy(), "no_id": found["no_id"].to_numpy(), "nth": found["nth"].to_numpy(), **take, "file": np.asarray(row["files"], object)[take["file"]]})


def _read(parts: Iterator[pa.RecordBatch], folder: str, kind: str, keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file and place: each stretch of a file is read once, in blocks."""
    fs, base = _file_system(folder)
    width, name, source = np.dtype(kind).itemsize, None, None
    first, held = 0, b""
    for part in parts:
        raw, crc = [], []
        for file, place, n in zip(*(part.column(c).to_pylist() for c in ("file", "place", "n_tokens")), strict=True):
            if file != name:
                name, source, first, held = file, fs.open_input_file(f"{base}/{file}"), 0, b""
            a, b = width * place, width * (place + n)
            if a < first or b > first + len(held):
                source.seek(a)
                first, held = a, source.read(max(b - a, READ_BYTES))
            ids = np.frombuffer(held, kind, n, a - first).astype("<u4").tobytes()
            raw.append(ids if keep else None)
            crc.append(zlib.crc32(ids))
        columns = [part.column(c) for c in ("doc_id", "shard", "place", "n_tokens")]
        yield pa.record_batch([*columns, pa.array(crc, pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32", "ids"])


def write_corpus(documents: DataFrame, path: str | None = None, end: int = END, folder: str | None = None) -> str:
    """Encode every document, append the end id and write the corpus; returns its folder.

    Documents stand in ascending doc_id order over all shards, null doc_ids first, rows of one
    doc_id in order of text. A null text is empty: its end id alone. One shuffle, of the texts.
    """
    from tokenizers import Tokenizer

    spark, path = documents.sparkSession, path or public_path()
    folder = folder or f"{shared_dir(spark)}/corpus"
    kind = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end + 1) <= 1 << 16 else "<u4"
    d = texts(documents)
    rows, size = d.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(1, -(-(size or 0) // SHARD_BYTES))
    d = d.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    d.mapInArrow(partial(_write, folder=folder, path=path, end=end, kind=kind), PLACES).write.parquet(f"{folder}/documents")
    places = spark.read.schema(PLACES).parquet(f"{folder}/documents")
    buckets = max(1, -(-rows // BUCKET_KEYS))
    keyed = places.withColumn("key", _key_hash()).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    keyed.select("bucket", "key", "file", "shard", "place", "n_tokens").groupBy("bucket").applyInPandas(_index, INDEX).write.parquet(f"{folder}/index")
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    totals.selectExpr("shard", "coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as before").write.parquet(f"{folder}/shards")
    spark.createDataFrame([(kind, buckets, rows, end)], "kind string, buckets long, rows long, end int").write.parquet(f"{folder}/format")
    return folder


def keys_of(documents: DataFrame) -> DataFrame:
    """(doc_id, nth): every key of a table, nth counting the rows of one doc_id from 0."""
    counted = documents.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return counted.select("doc_id", F.explode(F.expr("sequence(0L, n - 1)")).alias("nth"))


def read_corpus(spark: SparkSession, folder: str, keys: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the (doc_id, nth) rows of ``keys``, from the files.

    Keys that the corpus lacks give no row, but for one in about four thousand million whose
    fingerprint agrees by chance. ``start`` counts the ids of all documents before.
    """
    form = spark.read.parquet(f"{folder}/format").first()
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    # pandas has no null integers: a null doc_id travels as a flag
    keyed = keys.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("no_id"), "nth", _key_hash().alias("key")).withColumn("bucket", F.pmod("key", F.lit(form["buckets"])))
    found = keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_lookup, f"{PLACES}, no_id boolean")
    found = found.withColumn("doc_id", F.expr("if(no_id, null, doc_id)")).drop("no_id")
    found = found.repartition("file").sortWithinPartitions("file", "place")
    got = found.mapInArrow(partial(_read, folder=folder, kind=form["kind"], keep=keep_ids), "doc_id long, shard int, place long, n_tokens long, ids_crc32 long, ids binary")
    shards = spark.read.schema("shard int, before long").parquet(f"{folder}/shards")
    return got.join(shards, "shard").select("doc_id", F.expr("before + place").alias("start"), "n_tokens", "ids_crc32", "ids")
