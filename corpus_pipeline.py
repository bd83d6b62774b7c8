"""The corpus pipeline: documents to packed training sequences.

Each stage works on all rows its predecessor kept and its decisions take effect: toxic documents
go, one document of each group of near copies stays, personal data is replaced by its kind, and
what is left is packed. Stages but the last return the columns of documents. A null text is a text
without words: it is kept, linked with nothing, and packed as a single separator. Repeated rows are
near copies of each other, so one stays if they have words. Further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch.llm import neardup, packing, pii, toxicity
from lapsewatch.llm.common import in_fold, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Texts of an Arrow batch: Python workers outlive a stage, and so does the memory of its largest batch.
TOGETHER = 1000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; learned outside of fold 0 of five."""
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 5, 0))
    with neardup.batches_of(spark, TOGETHER):
        model = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
        return written(docs.where(toxicity.scorer(model)("text") < 0.5), "clean")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id.

    Rows are numbered in a written table, so that rows with the same doc_id, or none, are told apart.
    """
    number = "_row"
    if number in docs.columns:
        raise ValueError(f"a column {number} is there already")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = neardup.near_duplicates(rows, number, "text").where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", number))[number]
    members = written(groups.select(number, "component_id").join(
        rows.select(number, "doc_id"), number), "members")
    kept = members.groupBy("component_id").agg(first.alias("kept"))
    gone = members.join(kept, "component_id").where(F.col(number) != F.col("kept")).select(number)
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs, "text")
    if "n_chars" in clean.columns:
        kind = clean.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(
            F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    with neardup.batches_of(spark, TOGETHER):
        packed = packing.pack_texts(docs, "doc_id", "text", path)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: The stages learn, hash and tokenise; SQL cannot express them, tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each on the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
