"""Written tables: the way this subpackage cuts lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.session import shared_dir

#: Spark's setting that removes the shuffle files of a query when it ends; else they wait for the driver's garbage collector.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read again.

    Later steps then start from files that every executor can reach, so a lost executor
    costs no more than its own tasks. Nothing reads the shuffles of the write again: they go with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def texts(documents: DataFrame) -> DataFrame:
    """Only (doc_id, text): no other column, whatever its name, reaches an operator."""
    return documents.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
