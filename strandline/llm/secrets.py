"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is a blob named by the SHA-256 of its text. The ledger holds
the (blob, rule version) pairs that have been scanned; a scan takes only blobs that lack a
pair, each once, and its findings are joined back to every path that holds the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from strandline.llm.store import texts, written

RULES = 1
KINDS = ("assign", "access", "hex")
SEPARATOR = r"""["']?\x20*[:=]\x20*["']?"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(f"(?:{'|'.join(_either(w) for w in NAMES)}){SEPARATOR}([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text with a secret has a match of this, in Spark's own expressions as well (plain ASCII classes only).
POSSIBLE = "|".join(rule.pattern for rule in (ASSIGN, ACCESS, HEX))
#: Every assignment holds one of these, so texts without them skip the longer pattern.
HINT = re.compile("|".join(_either(w) for w in ("passw", "secret", "token", "api")))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of one text, in order of start and then of kind."""
    found = []
    if HINT.search(text):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def mask(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """``text`` with every secret replaced by its kind in angle brackets; overlaps become one."""
    if not text or not found:
        return text
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


FOUND = "array<struct<kind:string, start:bigint, end:bigint>>"


def _distinct(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first text of every blob of this task: copies do not travel."""
    seen: set[bytes] = set()
    for part in parts:
        keep = []
        for i, x in enumerate(part.column("blob").to_pylist()):
            key = bytes.fromhex(x)
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield part.take(pa.array(keep, pa.int64()))


def _scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by blob: scan the first of each, skip its other copies."""
    last = None
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in parts:
        blobs, found = [], []
        for blob, text in zip(part.column("blob"), part.column("text"), strict=True):
            blob = blob.as_py()
            if blob != last:
                last = blob
                blobs.append(blob)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in scan(text.as_py())])
        yield pa.record_batch([pa.array(blobs, pa.string()), pa.array(found, kinds)], names=["blob", "found"])


def versions(documents: DataFrame) -> DataFrame:
    """(doc_id, blob, text): each document version with its content address; null text is empty."""
    d = texts(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("blob"), "text")


def empty_ledger(documents: DataFrame) -> DataFrame:
    return documents.sparkSession.createDataFrame([], f"blob string, rules int, found {FOUND}")


def scan_unseen(documents: DataFrame, ledger: DataFrame | None = None, rules: int = RULES) -> DataFrame:
    """New ledger rows (blob, rules, found) for blobs that ``ledger`` lacks under ``rules``.

    Copies are dropped within each task before the shuffle and again after it, so a blob that
    fills a third of the table sends one row per task and is scanned once.
    """
    blobs = versions(documents).select("blob", "text").mapInArrow(_distinct, "blob string, text string")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    blobs = blobs.repartition("blob").sortWithinPartitions("blob")
    return blobs.mapInArrow(_scanned, f"blob string, found {FOUND}").select("blob", F.lit(rules).alias("rules"), "found")


def find_secrets(documents: DataFrame, ledger: DataFrame | None = None, rules: int = RULES) -> tuple[DataFrame, DataFrame]:
    """((doc_id, blob, found) of every document, the ledger with the new blobs).

    Null and empty texts are the empty blob, without findings. Rows with a null or repeated
    doc_id are paths of their own. An empty table gives empty results.
    """
    fresh = written(scan_unseen(documents, ledger, rules), "ledger")
    known = fresh if ledger is None else ledger.select(fresh.columns).union(fresh)
    found = known.where((F.col("rules") == rules) & (F.size("found") > 0)).select("blob", "found")
    paths = versions(documents).select("doc_id", "blob")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found")), known


def report(found: DataFrame) -> DataFrame:
    """The digest of each document: counts by kind, hash of the spans, the spans."""
    spans = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(found, f -> f.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(spans, "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"))


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


@F.pandas_udf(StringType())
def masked(text, found):
    import pandas as pd

    return pd.Series([mask(t, [(f["kind"], f["start"], f["end"]) for f in x]) for t, x in zip(text, found, strict=True)], dtype=object)


def redacted(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``documents`` with every secret in ``text`` masked and ``n_chars``, if there, counted anew.

    All rows and columns are kept; rows without a secret are unchanged. Only rows that can hold
    one travel to the findings of their blob; all others stay where they are.
    """
    fresh = written(scan_unseen(documents, ledger), "ledger")
    known = fresh if ledger is None else ledger.where(F.col("rules") == RULES).select(fresh.columns).union(fresh)
    found = known.where(F.size("found") > 0).select("blob", "found")
    d = documents.select(F.struct("*").alias("row"))
    possible = F.coalesce(F.col("row.text").cast("string").rlike(POSSIBLE), F.lit(False))
    some = d.where(possible).withColumn("blob", F.sha2(F.encode(F.col("row.text").cast("string"), "UTF-8"), 256)).join(found, "blob", "left")
    d = some.select("row", "found").union(d.where(~possible).select("row", F.lit(None).cast(FOUND)))
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.coalesce("found", F.array().cast(FOUND))))
    d = d.withColumn("masked", text)
    columns = []
    for c in documents.columns:
        new = {"text": F.col("masked"), "n_chars": F.when(F.col("found").isNull(), F.col("row.n_chars")).otherwise(F.char_length("masked"))}.get(c)
        columns.append(F.col(f"row.`{c}`").alias(c) if new is None else new.cast(documents.schema[c].dataType).alias(c))
    return d.select(*columns)
