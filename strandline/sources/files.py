"""Delimited files: explicit schemas in, partitioned files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Country x year observations as statistical offices publish them.
CROSS_SECTION = (
    "LOCATION string, INDICATOR string, SUBJECT string, MEASURE string, FREQUENCY string, "
    "TIME string, Value double, `Flag Codes` string"
)
BARS = "ts date, open double, high double, low double, close double, volume long"


def read_csv(spark: SparkSession, path: str, schema: str, date_col: str | None = None, date_format: str | None = None) -> DataFrame:
    """CSV with a header row and a fixed schema.

    With ``date_format`` (``yyyyMM``, ``M/d/yyyy``, ...) the date column is read
    as text and parsed; rows whose date does not parse get a null date.
    """
    df = spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", mode="PERMISSIVE")
    if date_col and date_format:
        parsed = F.to_date(F.try_to_timestamp(F.col(date_col), F.lit(date_format)))
        df = df.withColumn("ts", parsed).drop(date_col) if date_col != "ts" else df.withColumn("ts", parsed)
    elif date_col and date_col != "ts":
        df = df.withColumnRenamed(date_col, "ts")
    return df


def ingest(df: DataFrame, start=None, end=None, names: Sequence[str] | None = None, change: str = "none", col: str = "value") -> DataFrame:
    """Select series and dates (both reach the scan), then apply a change on read."""
    from strandline.operators import transform as tr

    if names is not None:
        df = df.filter(F.col("series_id").isin(list(names)))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1))  # the last day whole
    rules = {
        "none": lambda d: d.withColumn("changed", F.col(col)),
        "pct_change": lambda d: tr.pct_change(d, col, out="changed"),
        "yoy": lambda d: tr.pct_change(d, col, 12, out="changed"),
        "diff": lambda d: tr.difference(d, col, out="changed"),
        "log": lambda d: d.withColumn("changed", F.when(F.col(col) > 0, F.log(F.col(col)))),
    }
    if change not in rules:
        raise ValueError(f"unknown change {change!r}; use one of {sorted(rules)}")
    return rules[change](df)


def coalesce_columns(df: DataFrame, candidates: Sequence[str], out: str = "value") -> DataFrame:
    """First non-null of the candidate columns that exist; at least one must."""
    present = [F.col(f"`{c}`").cast("double") for c in candidates if c in df.columns]
    if not present:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return df.withColumn(out, F.coalesce(*present))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write results, one folder per parameter value.

    Rows are rebalanced by the partition columns first: AQE splits a large
    partition over several files and packs small ones together.
    """
    if fmt not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {fmt!r}")
    out = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
