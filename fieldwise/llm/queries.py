"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_prints, diagonals, exact_dedup, host_reputation, oracles, order_minhash, output_codes
from . import pivot_clusters, sharding, site_quality, spaced_seeds, sql_bpe, stripes, token_files
from .common import table

SHARDS = 24
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

PAGE_DOC = r"/([0-9]+)(?:\.[^/]*)?/*\z"


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(SHARDS)
    return sharding.place(table(spark, sf_dir, "documents"), tree, sharding.grown(tree, SHARDS))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document whose id ends its url's path (``/7``, ``/7/``, ``/7.html``)."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    linked = pages.select("url", F.regexp_extract(host_reputation.path_of(F.col("url")), PAGE_DOC, 1).alias("page_doc"))
    linked = linked.withColumn("page_doc", F.expr("try_cast(page_doc as bigint)"))
    known = labels.select(F.col("doc_id").alias("l_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    outcomes = linked.join(known, F.col("page_doc") == F.col("l_id")).select("url", "bad")
    return host_reputation.judge(pages, outcomes, RULES)


def op5_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return output_codes.identify(docs, docs)


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chunk_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_prints.prints(table(spark, sf_dir, "documents"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scored = site_quality.score(docs, site_quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.round("q_text", 6).alias("text_evidence"), F.round("q_rate", 6).alias("path_rate"),
        F.round("q_score", 6).alias("score"), (F.col("q_score") >= 0.5 - 1e-12).alias("kept"),
    )


def op9_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagonals.scan(table(spark, sf_dir, "documents"))


def op10_sql_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_bpe.encode_decode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )


def op11_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree, op2_order_minhash, op3_token_files, op4_host_reputation, op5_output_codes,
        op6_spaced_seeds, op7_chunk_prints, op8_site_quality, op9_diagonals, op10_sql_bpe,
        op11_bloom_dedup, op12_pivot_clusters, op13_stripes,
    )
}
ORACLES: dict[str, str] = {
    "op4_host_reputation": oracles.host_verdicts_sql(RULES, PAGE_DOC),
    "op11_bloom_dedup": oracles.EXACT_DEDUP,
    "op12_pivot_clusters": oracles.clusters_sql(),
    "op13_stripes": oracles.COLLOCATIONS,
}
