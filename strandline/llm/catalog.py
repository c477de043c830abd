"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import balance, jaccard, kdtree, langid, lexical, merkle, oracles, packing, pieces, quality, secrets, shards, toxicity, vectors
from strandline.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = secrets.find_secrets(table(spark, folder, "documents"))
    return secrets.report(found)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    corpus = shards.write_corpus(documents)
    return shards.read_corpus(spark, corpus, shards.keys_of(documents), keep_ids=False).drop("ids")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op1_ngram_jaccard_links(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked(table(spark, folder, "documents")).select("doc_id", "n_shingles", "n_links", "component_id")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return kdtree.top_k(table(spark, folder, "embeddings"))


def op8_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.sample_checked(table(spark, folder, "documents"))


def op11_balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    return balance.sharded(table(spark, folder, "documents"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(merkle.proofs(table(spark, folder, "documents")))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_token_shards": op2_token_shards,
    "op3_secret_scan": op3_secret_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_quality": op9_quality,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_balanced_shards": op11_balanced_shards,
    "op12_ranked_search": op12_ranked_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Only what SQL can express: the other operators are tested by brute force, round trip or accuracy.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.JACCARD,
    "op3_secret_scan": oracles.SECRETS,
    "op6_embedding_near_dedup": oracles.NEAR_VECTORS,
    "op10_exact_top_k": oracles.TOP_K,
    "op12_ranked_search": oracles.RANKED,
    "op13_merkle_manifest": oracles.MERKLE,
}

#: Further results of the operators above, each with its SQL.
FURTHER: dict[str, Query] = {"op1_ngram_jaccard_links": op1_ngram_jaccard_links}
FURTHER_ORACLES: dict[str, str] = {"op1_ngram_jaccard_links": oracles.JACCARD_LINKS}
