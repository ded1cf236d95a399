"""Ordering and grouping helpers that survive one key holding a third of all rows.

A plain window sends a whole partition key to one task. The helpers below split such a key
by an order-preserving bucket first, and combine the buckets through a table that has one
row per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from costproof.session import materialize

# Rows of one key that may share a task: 2 ** BUCKET_BITS.
BUCKET_BITS = 16


def merged(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """An equality join by sorted shuffles, for sides that ``explode`` makes larger: Spark's estimate does not see the added
    rows, takes such a side for small, and would bring all of it to the driver to broadcast it."""
    return left.hint("merge").join(right, on if isinstance(on, str) else list(on), how)


def first_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str] | None = None
) -> DataFrame:
    """The first row per key by ``order``; combined map-side, so a hot key shuffles one
    row per input partition."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.min_by(F.struct(*keep), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_first")[c].alias(c) for c in keep])


def order_index(df: DataFrame, order: Sequence[Column | str], out: str = "ord") -> DataFrame:
    """A unique BIGINT that increases along ``order`` over the whole table.

    The sort is a range exchange over the order columns, so no key has to fit one task. The
    result is materialised: the id depends on the partitioning and must not be recomputed.
    """
    return materialize(df.orderBy(*order).withColumn(out, F.monotonically_increasing_id()))


def rank_by_index(
    df: DataFrame, keys: Sequence[str], index: str, out: str = "rn", bits: int = BUCKET_BITS
) -> DataFrame:
    """``row_number`` per key along a unique BIGINT column, for keys of any size."""
    keys = list(keys)
    bucketed = df.withColumn("_b", F.shiftright(F.col(index).cast("bigint"), bits))
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(index)).cast("bigint")
    counts = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_ob"),
        F.coalesce(before, F.lit(0)).alias("_off"),
    )
    match = F.col("_b") == F.col("_ob")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = bucketed.withColumn("_local", local).join(offsets, match, "inner")
    return ranked.select(*df.columns, (F.col("_local") + F.col("_off")).alias(out))


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rn"
) -> DataFrame:
    """``row_number`` per key along any order (end it with a unique column)."""
    indexed = order_index(df, order, "_ord")
    return rank_by_index(indexed, keys, "_ord", out).drop("_ord")


def running_last(
    df: DataFrame, keys: Sequence[str], index: str, marker: Column, out: str, bits: int = BUCKET_BITS
) -> DataFrame:
    """The largest ``index`` so far, per key, at which ``marker`` was true (else null).

    This is the "last header above this row" rule: a running maximum, split by index bucket.
    """
    keys = list(keys)
    marked = df.withColumn("_m", F.when(marker, F.col(index))).withColumn(
        "_b", F.shiftright(F.col(index).cast("bigint"), bits)
    )
    inside = F.max("_m").over(
        Window.partitionBy(*keys, "_b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    )
    tops = marked.groupBy(*keys, "_b").agg(F.max("_m").alias("_top"))
    carried = F.max("_top").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = tops.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_ob"), carried.alias("_carry")
    )
    match = F.col("_b") == F.col("_ob")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = marked.withColumn("_in", inside).join(carry, match, "inner")
    return joined.select(*df.columns, F.coalesce("_in", "_carry").alias(out))


def is_empty(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) == 0
