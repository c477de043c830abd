import math
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings, strategies as st

from strandline.llm import catalog, pieces
from tests.conftest import SF

PATH = pieces.public_model()
SAMPLER = pieces.Sampler(pieces.Vocabulary(PATH))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.text(st.sampled_from("ab the  \n▁é\x00中😀ñ") | st.characters(codec="utf-8"), max_size=30)


def encode(texts, keys=None, sampler=SAMPLER):
    out = []
    for _, ids, ends in sampler.encode(pa.array(texts, pa.string()), pieces.row_keys(keys or list(range(len(texts))), 1)):
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_decoding_gives_the_text_back(texts):
    for text, ids in zip(texts, encode(texts), strict=True):
        assert SAMPLER.v.decode(ids) == text
        if "▁" not in text:
            assert LIBRARY.decode(ids) == text


def test_signs_that_pieces_use_for_others():
    texts = ["\x00\x00", "▁", "a▁ ▁b", "\ue000", " \ue000▁ ", "\x00"]
    assert [SAMPLER.v.decode(ids) for ids in encode(texts)] == texts


def paths(text):
    """Every segmentation with its weight, by plain recursion over the pieces."""
    v = SAMPLER.v

    def of(rest):
        if not rest:
            yield [], 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in v.names:
                i = [v.names[rest[:k]]]
                w = v.weight[i[0]]
            elif k == 1:
                i = [v.byte[b] for b in rest[0].encode()]
                w = v.least * len(i)
            else:
                continue
            for more, x in of(rest[k:]):
                yield i + more, w + x

    return list(of("▁" + text.replace(" ", "▁")))


def test_samples_follow_the_exact_distribution():
    for text in ("there", "a  be", "né\n😀x"):
        every = paths(text)
        total = math.log(sum(math.exp(w) for _, w in every))
        n = 20_000
        got = Counter(map(tuple, encode([text] * n)))
        chance = Counter()
        for ids, w in every:
            chance[tuple(ids)] += math.exp(w - total)
        assert set(got) <= set(chance)
        likely = {k: p for k, p in chance.items() if p * n >= 5}
        square = sum((got[k] - n * p) ** 2 / (n * p) for k, p in likely.items())
        assert square < len(likely) + 6 * math.sqrt(2 * len(likely)) + 10
        unit = [u for u in SAMPLER.number if u == text.encode()]
        if unit:
            assert abs(SAMPLER.total[SAMPLER.number[unit[0]]] - total) < 1e-9


def test_ids_depend_on_key_and_text_alone(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    whole = encode([t for _, t in rows], [i for i, _ in rows], pieces.Sampler(SAMPLER.v, known=50))
    assert whole == [encode([t], [i])[0] for i, t in rows]
    assert whole != encode([t for _, t in rows], [i + 1 for i, _ in rows])


def test_edge_rows(documents):
    rows = [(1, None), (2, ""), (3, "twice"), (3, "twice"), (None, "no key"), (4, " "), (5, "x" * 3000), (6, "many words " * 30_000)]
    got = pieces.sample(documents(rows))
    back = pieces.decode(got).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert len({tuple(r["ids"]) for r in got.collect() if r["doc_id"] == 3}) == 1
    assert pieces.sample(documents([])).count() == 0


def test_query_over_the_small_table(spark):
    rows = catalog.op8_piece_sampling(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r["lossless"] and len(r["ids"]) == r["n_pieces"] for r in rows)
    assert all(LIBRARY.decode(r["ids"]) == texts[r["doc_id"]] for r in rows[:50])
