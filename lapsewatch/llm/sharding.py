"""Sharding by histogram sort: shards of near equal bytes, cut from one total order of the rows.

Rows are ordered by a 128-bit key: a hash of the text, then a hash of the row's id, so equal texts
are neighbours and a hot text can still be cut between two rows. Splitters are searched by
counting: every round counts the exact bytes below a set of candidate keys over all partitions,
and narrows each splitter to the gap that holds its target. The least and greatest key of a gap
come with the counts, so a gap full of copies narrows to their id hashes at once. A splitter is
done when it is within the tolerance of its target, or when its gap holds a single key. Then the
rows are exchanged once.

Size is the UTF-8 bytes of the text plus a fixed number for the row. A null or empty text has that
number only. Rows with the same id and text share a key and so a shard. An empty table gives no
rows. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsewatch.llm.common import by_batch, partitions, written

SHARDS = 24
ROW_BYTES = 8
#: Part of a mean shard's bytes that a splitter may be off.
TOLERANCE = 0.001
#: Candidate keys of one gap in one round.
PROBES = 32
ROUNDS = 64
#: Rows that one task numbers, about.
NUMBERED_TOGETHER = 100_000


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, size, crc32 of the text, and the order as two numbers ``high`` and ``low``."""
    coded = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(
        F.col(key).alias("key"), (F.octet_length(coded) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(coded).alias("text_crc32"), F.xxhash64(coded, F.lit(1)).alias("high"),
        F.xxhash64(F.col(key).cast("string"), F.lit(2)).alias("low"))


#: The order as one integer from 0 to 2 to the 128th.
def _number(high: int, low: int) -> int:
    return ((high + (1 << 63)) << 64) | (low + (1 << 63))


def _halves(number: int) -> tuple[int, int]:
    return (number >> 64) - (1 << 63), (number & ((1 << 64) - 1)) - (1 << 63)


def _places(high: np.ndarray, low: np.ndarray, bounds: list[int]) -> np.ndarray:
    """For each row the number of bounds at or below it."""
    pairs = [_halves(b) for b in bounds]
    tops = np.array([p[0] for p in pairs], np.int64)
    place = np.searchsorted(tops, high, "left")
    tied = np.searchsorted(tops, high, "right")
    for i in np.flatnonzero(tied > place):
        lows = [p[1] for p in pairs[place[i]:tied[i]]]
        place[i] += bisect_left(lows, int(low[i]) + 1)
    return place


def _histogram(rows: DataFrame, bounds: list[int]) -> list:
    """Bytes, rows, least and greatest key between each two neighbouring bounds."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        high, low = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        place, size = _places(high, low, bounds), batch.column(2).to_numpy()
        order = np.lexsort((low, high, place))
        cell, first = np.unique(place[order], return_index=True)
        last = np.append(first[1:], len(order)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(np.add.reduceat(size[order], first)),
             pa.array((last - first + 1).astype(np.int64)),
             *[pa.array(a[order][at]) for at in (first, last) for a in (high, low)]],
            ["cell", "size", "n", "high0", "low0", "high1", "low1"])

    counted = by_batch(rows.select("high", "low", "size"), work,
                       "cell int, size bigint, n bigint, high0 bigint, low0 bigint, "
                       "high1 bigint, low1 bigint")
    return counted.groupBy("cell").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"),
        F.min(F.struct("high0", "low0")).alias("least"),
        F.max(F.struct("high1", "low1")).alias("most")).collect()


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE) -> tuple[list[int], int]:
    """``parts`` - 1 keys that cut the rows into near equal bytes, and the number of rows.

    What reaches the driver is one row per candidate, at most ``parts`` times ``PROBES``.
    """
    top = 1 << 128
    step = top // (parts * PROBES)
    bounds = list(range(step, top - step + 1, step))
    found: dict[int, int] = {}
    gaps: dict[int, tuple[int, int]] = {}  # splitter -> bytes below its gap, bytes in it
    total = rows_in_all = 0
    for turn in range(ROUNDS):
        cells = {r.cell: r for r in _histogram(rows, bounds)}
        if turn == 0:
            total = sum(r.size for r in cells.values())
            rows_in_all = sum(r.n for r in cells.values())
            if not total:
                return bounds[:parts - 1], 0
        slack, below, at = max(1, tolerance * total / parts), 0, {}
        for cell in range(len(bounds) + 1):
            at[cell] = below
            below += cells[cell].size if cell in cells else 0
        probes = set()
        for i in range(1, parts):
            if i in found:
                continue
            target = total * i / parts
            # The gap that holds the target: the last cell that starts at or below it.
            cell = max(c for c in cells if at[c] <= target)
            start, stop = at[cell], at[cell] + cells[cell].size
            least, most = (_number(*cells[cell][name]) for name in ("least", "most"))
            if target - start <= slack or (least == most and target - start <= stop - target):
                found[i] = least
            elif stop - target <= slack or least == most:
                found[i] = most + 1
            else:
                gaps[i] = (start, stop)
                width = (most - least) // PROBES + 1
                probes.update(range(least + 1, most + 1, width))
                # Both ends of the two hashes: a gap of copies opens on its ids, others on texts.
                probes.update({least, most, most + 1, ((least >> 64) + 1) << 64, (most >> 64) << 64})
        if len(found) == parts - 1:
            break
        bounds = sorted({p for p in probes if 0 < p < top} | set(found.values()))
    else:
        raise RuntimeError(f"{len(found)} of {parts - 1} splitters found in {ROUNDS} rounds")
    return [found[i] for i in sorted(found)], rows_in_all


def shard(df: DataFrame, key: str, text: str, shards: int = SHARDS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row: key, size, text_crc32, shard and slot, the slots of a shard gapless from 0.

    Every shard is cut further into ranges of near equal bytes that one task each numbers.
    """
    spark = df.sparkSession
    rows = written(keyed(df, key, text), "keyed")
    cuts, number = splitters(rows, shards, tolerance)
    ranges = max(1, number // NUMBERED_TOGETHER // shards + 1, partitions(spark) // shards)
    fine, _ = splitters(rows, shards * ranges, 0.2) if ranges > 1 else ([], 0)
    bounds = sorted({*cuts, *fine})
    names = {bound: i for i, bound in enumerate(bounds)}
    edges = np.array([names[c] for c in cuts], np.int64) if cuts else np.zeros(0, np.int64)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        high, low = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("high", "low"))
        place = _places(high, low, bounds)
        shard_of = np.searchsorted(edges, place - 1, "right")
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(place.astype(np.int32)), pa.array(shard_of.astype(np.int32))],
            [*batch.schema.names, "range", "shard"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = by_batch(rows, work, f"{fields}, range int, shard int")
    before = (placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(
                  Window.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n"))
    order = Window.partitionBy("shard", "range").orderBy("high", "low")
    return (placed.withColumn("place", F.row_number().over(order))
            .join(F.broadcast(before), ["shard", "range"])  # a row per range: bounded by the cuts
            .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                    (F.col("before") + F.col("place") - 1).cast("bigint").alias("slot")))
