import numpy as np
import pyarrow as pa

from strandline.llm import catalog, toxicity
from tests.conftest import SF

SMALL = SF.replace("0.001", "0.1")


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = catalog.op7_toxicity(spark, SMALL).join(truth.select("doc_id", truth.toxic.alias("label")), "doc_id").where("held_out").collect()
    y, p = np.array([r["label"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert (y & p).sum() / y.sum() > 0.8 and (y & p).sum() / p.sum() > 0.95
    assert all(0 <= r["toxic"] <= 1 and 0 <= r["low_quality"] <= 1 for r in rows)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_a_later_category_uses_an_earlier_one():
    """The second label is hard to tell from single words, but follows from the first."""
    r = np.random.default_rng(1)
    first = r.random(600) < 0.5
    texts = [" ".join(["bad" if y else "good", *(f"w{i}" for i in r.integers(0, 40, 20))]) for y in first]
    labels = np.stack([first, first], 1).astype(int)
    chain = toxicity.train(pa.array(texts), labels, ["a", "b"], np.ones(600))
    assert len(chain.weights[1]) == len(chain.known[1]) + 1 and chain.weights[1][-1] > 0
    assert ((chain.predict(pa.array(texts))[:, 1] > 0.5) == first).all()


def test_presence_is_that_of_the_words(spark):
    texts = ["Alpha beta, GAMMA!!", "alphabet soup", None, "", "x " * 600_000 + "gamma"]
    known = np.sort(np.concatenate([f for _, f, _ in toxicity.features(pa.array(["alpha beta gamma !!"]))]))
    held = toxicity.presence(pa.array(texts), np.unique(known)).sum(1)
    assert held.tolist() == [6.0, 1.0, 0.0, 0.0, 2.0]  # three words, two beginnings, one sign


def test_edge_tables(documents, spark):
    rows = [(1, "fine words"), (2, None), (2, ""), (None, "no key"), (3, "scum " * 9)]
    for marks in ([], [(1, 1, 0)], [(1, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1), (2, None, 1)]):
        got = toxicity.score(documents(rows), labels_of(spark, marks)).collect()
        assert len(got) == 5 and all(0 <= r["toxic"] <= 1 for r in got)
    assert toxicity.score(documents([]), labels_of(spark, [])).count() == 0
