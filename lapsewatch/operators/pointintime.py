"""Feature lookups by key and time: latest row, as-of join, merge of new rows.

A window per key would put all rows of a hot key in one task. Latest-row lookups are aggregates,
combined before the shuffle. The as-of join cuts the time line into slices that hold about the
same number of rows, so a hot key is spread over as many tasks as there are slices; what a slice
must know about earlier ones is one row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewatch import constants as K
from lapsewatch.operators.ranking import _slice_count, slice_of
from lapsewatch.operators.smalltables import materialise


def latest_per_key(features: DataFrame, key: str, at: str, values: Sequence[str],
                   tie: str | None = None, as_of: Column | None = None,
                   ttl_days: float | None = None) -> DataFrame:
    """Newest values per key, dropped when older than the time to live at ``as_of``."""
    order = F.struct(at, tie) if tie else F.col(at)
    newest = features.groupBy(key).agg(
        F.max_by(F.struct(at, *values), order).alias("_row")).select(key, "_row.*")
    if ttl_days is None:
        return newest
    oldest = as_of - F.expr(f"INTERVAL {round(ttl_days * 86400)} SECONDS")
    return newest.where(F.col(at) >= oldest)


def unknown_keys(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys without any feature row, with their number of requests.

    Both sides are reduced to distinct keys before the join, so a hot key is one row.
    """
    wanted = requests.groupBy(key).agg(F.count(F.lit(1)).alias("requests"))
    return wanted.join(known.select(key).distinct(), key, "left_anti")


def merge_latest(current: DataFrame, new_rows: DataFrame, key: str, at: str,
                 tie: str | None = None) -> DataFrame:
    """The table after taking in new rows: the newest row of every key."""
    values = [c for c in current.columns if c not in (key, at)]
    rows = current.unionByName(new_rows.select(*current.columns))
    return latest_per_key(rows, key, at, values, tie).select(*current.columns)


def as_of_join(entities: DataFrame, features: DataFrame, key: str, entity_at: str,
               feature_at: str, values: Sequence[str], tie: str, forward: bool = False,
               within_seconds: float | None = None, slices: int | None = None) -> DataFrame:
    """Each entity row with the last feature row at or before its time (first at or after it, with
    ``forward``), or nulls when there is none within ``within_seconds``.

    Feature rows at the very time of the entity count. ``tie`` orders feature rows of one instant.
    """
    slices = slices or _slice_count(entities)
    sign = -1 if forward else 1
    held = F.struct(F.col(feature_at), *[F.col(v) for v in values])

    def position(column: str) -> Column:
        return F.unix_micros(F.col(column).cast("timestamp")) * sign

    feature_rows = features.where(F.col(feature_at).isNotNull()).select(
        F.col(key), position(feature_at).alias("_at"), F.lit(0).alias("_kind"),
        F.col(tie).cast("bigint").alias("_tie"), held.alias("_held"),
        F.lit(None).cast(entities.select(F.struct("*")).schema[0].dataType).alias("_entity"))
    entity_rows = entities.select(
        F.col(key), position(entity_at).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(0).cast("bigint").alias("_tie"),
        F.lit(None).cast(feature_rows.schema["_held"].dataType).alias("_held"),
        F.struct(*entities.columns).alias("_entity"))
    # Both inputs are read once; what follows reads this table, mostly its narrow columns.
    rows = materialise(feature_rows.unionByName(entity_rows), "as-of")
    cuts = [i / slices for i in range(1, slices)]
    edges = rows.agg(F.percentile_approx("_at", cuts, 2000)).scalar()
    sliced = rows.withColumn("_edges", edges).withColumn(
        "_slice", slice_of(F.col("_at"), F.col("_edges"), slices)).drop("_edges")

    # Last feature row of every (key, slice), then of all earlier slices of the key.
    ends = sliced.groupBy(key, "_slice").agg(F.max_by(
        F.col("_held"), F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    seeds = ends.select(
        key, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_held")
    ).where("_held IS NOT NULL")
    seed_rows = seeds.select(
        key, F.lit(None).cast("bigint").alias("_at"), F.lit(-1).alias("_kind"),
        F.lit(0).cast("bigint").alias("_tie"), "_held",
        F.lit(None).cast(rows.schema["_entity"].dataType).alias("_entity"), "_slice")

    # Nulls come first, so the seed is the oldest row of its slice.
    order = Window.partitionBy(key, "_slice").orderBy("_at", "_kind", "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = sliced.unionByName(seed_rows).withColumn(
        "_found", F.last("_held", ignorenulls=True).over(order)).where("_kind = 1")
    found = F.col("_found")
    if within_seconds is not None:
        gap = F.abs(F.unix_micros(F.col(f"_entity.{entity_at}").cast("timestamp"))
                    - F.unix_micros(F.col(f"_found.{feature_at}").cast("timestamp")))
        found = F.when(gap <= round(within_seconds * 1_000_000), found)
    return joined.withColumn("_found", found).select("_entity.*", *[
        F.col(f"_found.{c}").alias(c) for c in (feature_at, *values)])


def point_in_time(entities: DataFrame, features: DataFrame, key: str, entity_at: str,
                  feature_at: str, values: Sequence[str], tie: str,
                  ttl_days: float = K.FEATURE_TTL_DAYS) -> DataFrame:
    """Training rows with the feature values known at the time, within their time to live."""
    return as_of_join(entities, features, key, entity_at, feature_at, values, tie,
                      within_seconds=ttl_days * 86400)


def delayed_labels(predictions: DataFrame, labels: DataFrame, key: str, predicted_at: str,
                   label_at: str, label: str, tie: str,
                   delay_days: float = K.LABEL_DELAY_DAYS) -> DataFrame:
    """Each prediction with the first label that follows it within the delay, or nulls.

    One row per prediction: pairs of a hot key's predictions and labels are never formed.
    """
    return as_of_join(predictions, labels, key, predicted_at, label_at, [label], tie,
                      forward=True, within_seconds=delay_days * 86400)
