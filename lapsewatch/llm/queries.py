"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch.llm import (
    bpe, lm, nearest, neardup, packing, pii, rangejoin, repair, secretscan, sharding, toxicity, whitening,
    wrappers,
)
from lapsewatch.llm.common import in_fold, table

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        JOBS[name] = job
        if sql is not None:
            CHECKS[name] = sql
        return job
    return register


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", ranks,
                     public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces with their place in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_texts(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_histogram_sharding")
def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes."""
    docs = sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op8_metric_range_join")
def op8_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among vectors of one label: links and components at a cosine of 0.98."""
    return rangejoin.range_join(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query("op10_projection_forest")
def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return nearest.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding",
                          F.col("vec_id") % 50 == 0)


@query("op6_weak_supervision_pii")
def op6_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those the span classifier adds."""
    found = pii.spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op3_lexicon_toxicity")
def op3_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned outside of fold 0 of five."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = in_fold("doc_id", 5, 0)
    model = toxicity.learn(docs, labels.where(~held), "doc_id", "text", "toxic")
    scored = docs.select("doc_id", held.alias("held_out"),
                         toxicity.scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_wrapper_extraction")
def op7_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    texts = wrappers.main_text(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op4_minhash_chosen_path")
def op4_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: components of links at a similarity of 0.75."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op2_log_bilinear_scoring")
def op2_log_bilinear_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned outside of fold 1 of five."""
    return lm.score(table(spark, sf_dir, "documents"), "doc_id", "text", in_fold("doc_id", 5, 1))


@query("op13_grammar_repair")
def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, its cheapest repair and the repaired text's hash."""
    return repair.repair(table(spark, sf_dir, "conversations"))


@query("op11_exact_whitening")
def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 32 leading components of all of them, at unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("op12_convolutional_secrets")
def op12_convolutional_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans, and candidates that the network accepts."""
    found = secretscan.spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2("base", 256).alias("base_sha256"), "spans")
