"""The operators of this subpackage as queries over the shared tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import (
    bpe,
    centroids,
    classifier,
    filter_audit,
    kdshards,
    langid,
    merkle,
    neardup,
    packing,
    perspectives,
    quality_rules,
    token_counts,
    url_lists,
)
from assayframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    quality_rules.oracle()
    + f" SELECT doc_id, {', '.join(_RULE_COLUMNS)} FROM judged"
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs, keep=["doc_id"]).select("row.doc_id", *_RULE_COLUMNS)


@query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", neardup.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digest = bpe.digester(path, public_tokenizers.PATTERN)
    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


TOKEN_LIMIT = 4096


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    )
    counted = token_counts.with_token_counts(
        docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "n_bytes"]
    )
    return counted.select(
        "row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query(merkle.oracle())
def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.half_edited(table(spark, sf_dir, "documents"))


SHARDS = 8


@query()
def op10_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sharded, _ = kdshards.shards(
        docs,
        SHARDS,
        {
            "n_chars": F.length("text").cast("bigint"),
            "lang": F.pmod(F.xxhash64("lang"), F.lit(1 << 20)),
            "source": F.pmod(F.xxhash64("source"), F.lit(1 << 20)),
            "doc_id": F.greatest("doc_id", F.lit(0)),
        },
        keep=["doc_id"],
    )
    flat = sharded.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", "shard")
    return kdshards.with_slots(flat, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.scored(docs, model, keep=["doc_id"], of_corpus=True).select(
        "row.doc_id",
        classifier.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"),
    )


@query(perspectives.oracle())
def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.perspectives(table(spark, sf_dir, "conversations"))


@query(url_lists.oracle())
def op8_url_list_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_lists.filter_captures(url_lists.dated_pages(pages), url_lists.dated_list(pages))
    return found.select(
        "row.page_id", "row.url", "row.fetched_at", "verdict", "matched_key", "listed_at",
        (F.col("verdict") != "block").alias("kept"),
    )


@query(centroids.oracle())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))[0]


@query(filter_audit.oracle())
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.with_language(docs, model, keep=["doc_id"]).select(
        "row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
