import zlib

import numpy as np
import pyarrow as pa

from strandline.llm import catalog, langid
from tests.conftest import SF


def test_held_out_accuracy(spark):
    got = catalog.op5_language_id(spark, SF.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_depend_on_the_text_alone(spark, documents):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fitted(d, 60)
    rows = [r["text"] for r in d.limit(60).collect()]
    both = model.predict(pa.array(rows))
    for k in (0, 7, 59):
        alone = model.predict(pa.array([rows[k]]))
        assert alone[0][0] == both[0][k] and abs(alone[1][0] - both[1][k]) < 1e-9
    assert model.predict(pa.array([None, "", "12 !!"], pa.string()))[0] == ["und"] * 3
    assert model.predict(pa.array(["", "ß", "中文", "x" * 300_000, "", "12"], pa.string()))[0][0] == "und"


def test_margins_are_those_of_the_features(spark):
    texts = pa.array([r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ["", None, "É", "ab"], pa.string())
    w = np.random.default_rng(0).normal(size=(langid.SIZE, 2))
    want = langid.features(texts) @ w + np.array([1.0, 2.0])
    assert np.allclose(langid.margins(texts, w, np.array([1.0, 2.0])), want, atol=1e-3)


def test_edge_tables(documents, spark):
    assert langid.identify(documents([])).count() == 0
    one = langid.identify(documents([(1, "just one"), (2, None), (None, "language here"), (2, "again")])).collect()
    assert sorted(r["lang_pred"] for r in one) == ["en", "en", "en", "und"]
    none = documents([(1, "text"), (2, None)]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert [r["lang_pred"] for r in langid.identify(none).collect()] == ["und", "und"]
