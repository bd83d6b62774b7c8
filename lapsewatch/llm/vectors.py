"""Vectors as bytes: usable ones only, and one row for equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch


def matrix(batch_column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of a list column that hold finite numbers and are not all zero, as double vectors."""
    column = batch_column
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    starts = np.cumsum(lengths) - lengths
    rows, found = [], []
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == length)
        block = flat[starts[at][:, None] + np.arange(length)]
        good = np.isfinite(block).all(1) & block.any(1)
        rows.append(at[good])
        found += list(block[good])
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), found


def usable(df: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    """Columns key, vec (doubles as bytes), width and group, without vectors that take no part.

    Those are null or empty ones, ones with a null or non-finite component, and zero vectors.
    """
    chosen = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vec"),
                       (F.col(group) if group else F.lit(0)).cast("string").alias("group"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = matrix(batch.column(1))
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array([v.tobytes() for v in found], pa.binary()),
             pa.array([len(v) for v in found], pa.int32()), batch.column(2).take(at)],
            ["key", "vec", "width", "group"])

    return by_batch(chosen, work, "key bigint, vec binary, width int, group string")


def stack(column) -> np.ndarray:
    """Vectors of one width, given as bytes, as the rows of a matrix."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; large components first shrink, so that squares stay finite."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
