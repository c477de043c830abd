import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import catalog, quality
from tests.conftest import SF

SMALL = SF.replace("0.001", "0.1")


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", "quality as label")
    rows = catalog.op9_quality(spark, SMALL).join(truth, "doc_id").where("held_out").collect()
    y, p = np.array([r["label"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert (p == y).mean() > 0.97 and (p[y == 0] == 0).mean() > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_passages_cover_the_whole_text():
    texts = ["", None, "one", " ".join(f"w{i}" for i in range(quality.PASSAGE * 3 + 1)), " \n ", "a " * 100_000]
    x, owner = quality.passages(pa.array(texts))
    assert np.bincount(owner).tolist() == [1, 1, 1, 4, 1, -(-100_000 // quality.PASSAGE)]
    assert np.isfinite(x).all()
    alone = [quality.passages(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x)


def test_gradients_by_finite_differences(monkeypatch):
    """One step of training moves the weights against the slope of the loss."""
    r = np.random.default_rng(3)
    texts = pa.array([" ".join("AB!!" if y and i % 3 == 0 else "word" for i in range(r.integers(1, 300))) for y in (0, 1) * 20])
    y, weight = np.array([0.0, 1.0] * 20), np.ones(40)
    loss = lambda m: -np.mean(np.log(np.where(y > 0, m.predict(texts), 1 - m.predict(texts))))
    losses = [loss(quality.train(texts, y, weight, steps=k)) for k in (0, 5, 60)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1


def test_attention_sums_to_one_and_scores_depend_on_the_text_alone(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    model = quality.train(pa.array(texts), np.array([0.0, 1.0] * 15), np.ones(30), steps=10)
    x, owner = quality.passages(pa.array(texts))
    f = model.forward(x, owner, 30)
    assert np.allclose(np.bincount(owner, f["a"]), 1)
    both = model.predict(pa.array(texts))
    assert both[7] == pytest.approx(model.predict(pa.array([texts[7]]))[0])


def test_edge_tables(documents, spark):
    rows = [(1, "fine words"), (2, None), (2, ""), (None, "no key"), (3, "BAD!! " * 9)]
    for marks in ([], [(1, 1)], [(1, 1), (3, 0), (3, 0), (None, 1), (2, None)]):
        labels = spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id long, quality int, toxic int")
        got = quality.score(documents(rows), labels).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert quality.score(documents([]), labels).count() == 0
