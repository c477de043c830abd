"""Bounded samples of labelled documents for fitting models on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def held_out() -> Column:
    """Documents never learned from: crc32 of the doc_id as text is divisible by 5, or no doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _share(rows: int, n: Column, *key: str) -> Column:
    """True for about ``rows`` of ``n`` rows, chosen by a hash of ``key``: alike on every run."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit(rows * (1 << 30)) / n


def by_label(documents: DataFrame, labels: DataFrame, columns: list[str], rows: int) -> pa.Table:
    """(text, *columns) of about ``rows`` labelled documents for each combination of labels.

    Held-out documents, null texts and rows with a null label take no part; a doc_id with
    several label rows counts once for each. The sample is chosen on the label table alone, so
    what is broadcast is bounded by ``rows`` and the number of label combinations.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns])
    marks = marks.where(~held_out()).dropna()
    counts = marks.groupBy(*columns).agg(F.count("*").alias("n"))
    chosen = marks.join(F.broadcast(counts), columns).where(_share(rows, F.col("n"), "doc_id")).drop("n")
    d = documents.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").where("text is not null")
    got = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *columns).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return got.set_column(1, "text", got.column("text").cast(pa.large_string()))


def class_weights(got: pa.Table, labels: DataFrame, columns: list[str]):
    """Weights that give each combination of labels of the sample its share of all labelled rows."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns]).where(~held_out()).dropna()
    n = {tuple(r[c] for c in columns): r["n"] for r in marks.groupBy(*columns).agg(F.count("*").alias("n")).collect()}
    rows = list(zip(*(got.column(c).to_pylist() for c in columns), strict=True))
    have = {k: rows.count(k) for k in set(rows)}
    return [n[k] / have[k] for k in rows]
