import pytest


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with internal ones."""

    def build(rows):
        rows = [(i, t, "en", "s", None, "x", 7, None) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, blob string, n int, found string").repartition(3)

    return build


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small fixtures: fewer tasks, less waiting."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
