"""Helpers the operators of this subpackage share: tables, written intermediates, word streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewatch.session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark from wherever ``sf_dir`` is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, no lineage to lose."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(key: Column | str, folds: int, fold: int) -> Column:
    """crc32 of the key's decimal text modulo ``folds`` equals ``fold``; a null key is in no fold."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) UTF-8 words between ASCII white space.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: exactly A-Z, and 0x20 and 0x09-0x0D.
    """
    return text.encode("utf-8").lower().split() if text else []


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch],
             schema: str, rows: int | None = None) -> DataFrame:
    """``work`` on every Arrow batch of the rows, or on slices of ``rows`` rows, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, rows or max(1, batch.num_rows)):
                yield work(piece)
        # A worker waits for other tasks; what Arrow keeps for itself meanwhile nobody else can use.
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def pieces_of(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so Python objects exist for a few rows at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def run_lengths(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts of an integer array."""
    return np.unique(codes, return_counts=True)
