"""Written intermediate tables, joins with small ones, and partitions for repeated passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lapsewatch.session import scratch_path, shared_folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe when an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_they_lie(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, read from the shared folder.

    What made them is forgotten: a chain of many small jobs then sends no task the whole plan again.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, key: str = "customerID", most: int | None = None) -> DataFrame:
    """The rows dealt out by a hash of their key over the session's shuffle partitions, ``most`` at most.

    For work that passes over the rows many times, such as fitting a model: neither the number of
    files nor that of the cores decides which rows are together, so a fit that draws from its
    partitions gives the same model on any cluster with the same setting.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts if most is None else min(parts, most)
    return df.repartition(parts, *([key] if key in df.columns else df.columns))


def join_small(large: DataFrame, grouped: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of groups that is written first.

    Its size is then known to the optimizer, which broadcasts it below its own threshold and else
    shuffles, splitting skewed keys at run time.
    """
    return large.join(materialise(grouped, "groups"), list(on), how)
