import pyarrow as pa
import pytest

import corpus_pipeline
from strandline.llm import langid, packing, secrets, toxicity
from tests.conftest import SF
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens_packing import ids_of


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_every_stage_against_brute_force(spark, monkeypatch):
    """Each stage alone on what the one before kept; then the whole run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "ngram_jaccard", "secret_scan", "best_fit_packing"]

    rows = rows_of(docs)
    got = stages["language_id"](spark, docs, SF)
    lang = langid.fitted(docs).predict(pa.array([t for _, t in rows]))[0]
    rows = [r for r, x in zip(rows, lang, strict=True) if x != "und"]
    assert got.columns == columns and rows_of(got) == rows

    docs, before = got, rows
    got = stages["toxicity"](spark, docs, SF)
    chain = toxicity.fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = chain.predict(pa.array([t for _, t in before]))[:, 1] >= 0.5
    rows = [r for r, x in zip(before, toxic, strict=True) if not x]
    assert got.columns == columns and rows_of(got) == rows

    docs = got
    got = stages["ngram_jaccard"](spark, docs, SF)
    stay = {c for _, _, c in brute(rows, percent=80, width=5)}
    rows = [r for r in rows if r[0] in stay]
    assert got.columns == columns and rows_of(got) == rows

    docs = got
    got = stages["secret_scan"](spark, docs, SF)
    rows = [(i, secrets.mask(t, secrets.scan(t))) for i, t in rows]
    assert got.columns == columns and rows_of(got) == rows
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())

    pieces = corpus_pipeline.run(spark, SF).collect()
    want = sorted((i, k, len(ids[a : a + 2048])) for i, t in rows for ids in [[*ids_of(t), 0]] for k, a in enumerate(range(0, len(ids), 2048)))
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in pieces) == want
    assert packing.check_places([(r["sequence_id"], r["offset"], r["length"]) for r in pieces])


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (2, ""), (None, "no key at all here"), (3, "same words in this one"), (3, "same words in this one"), (3, "other words of that id"), (4, "same words in this one"), (None, None), (5, "secret:abcdefghij and more"), (6, "12 !!")]])
def test_stages_on_edge_rows(documents, spark, rows):
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "ngram_jaccard":
            got = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert len(got) == (4 if rows else 0)
            assert got.count((3, "same words in this one")) == (1 if rows else 0) and (4, "same words in this one") not in got
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = out
        else:
            assert (out.count() > 0) == bool(rows)


def test_one_of_each_keeps_rows_without_words(documents):
    from strandline.llm import jaccard

    rows = [(1, None), (1, None), (2, ""), (2, "  "), (None, None), (7, "a b"), (8, "A b"), (None, "a b")]
    got = jaccard.one_of_each(documents(rows))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([r for r in rows if r not in [(8, "A b"), (None, "a b")]], key=str)
