"""Building blocks that keep hot groups out of single tasks.

A group (a cell, a chromosome, a label) may hold a third of all rows, so ranks and exact quantiles inside a
group are computed from one range sort over (group, order): a hot group simply spans several range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactmill.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below this bit


def _name_of(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where null equals null; the key columns of the left side stay."""
    own = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(own)
    same = [left[k].eqNullSafe(other[own[k]]) for k in keys]
    return left.join(other, same).drop(*own.values())


def rank_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """Number the rows of each group 1..n by `order`, like row_number, with no task bound to one group.

    Rows are range-partitioned and sorted by (groups, order) and written once, so that partition ids are
    fixed. The (group, partition) runs are contiguous; their lengths give each run its starting rank.
    """
    keys = [F.col(g) for g in groups] + [_name_of(o) for o in order]
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", _ROW_BITS))
    runs = placed.groupBy(*groups, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_len"))
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*groups, "_part", "_first", F.coalesce(F.sum("_len").over(earlier), F.lit(0)).alias("_before"))
    return _joined(placed, starts, [*groups, "_part"]).select(
        *df.columns, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).alias(name)
    )


def quantile_within(df: DataFrame, groups: Sequence[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Exact linearly interpolated quantile of `value` per group (one row in total for no groups).

    Equal values collapse to one row before the range sort: a value that most rows share would fill one of its tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sum(counted, groups, [value], "_c", "_upto")
    sized = with_totals(cum, groups, _n=F.max("_upto")) if groups else cum.withColumn("_n", cum.select(F.max("_upto")).scalar())
    spot = (F.col("_n") - 1) * F.lit(float(q))
    low = F.min(F.when(F.col("_upto") > F.floor(spot), F.col(value)))
    high = F.min(F.when(F.col("_upto") > F.floor(spot) + 1, F.col(value)))
    return sized.groupBy(*groups).agg((low + (F.coalesce(high, low) - low) * F.max(spot - F.floor(spot))).alias(name))


def mean_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Per distinct value of a group: its count and its average 1-based rank (ties share it).

    Equal values collapse to one row before ranking, so a value shared by many rows costs nothing extra.
    """
    counted = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sum(counted, groups, [value], "_c", "_upto")
    return cum.select(*groups, value, F.col("_c").alias("n"), (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name))


def running_sum(
    df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], amount: str, name: str
) -> DataFrame:
    """Inclusive running sum of `amount` per group in `order`, with no task bound to one group."""
    keys = [F.col(g) for g in groups] + [_name_of(o) for o in order]
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    )
    # 64 k neighbouring rows form one chunk: windows see chunks only, never a whole group
    placed = placed.withColumn("_chunk", F.shiftright("_pos", 16))
    chunks = placed.groupBy(*groups, "_chunk").agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select(*groups, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum(amount).over(inside))
    return _joined(local, starts, [*groups, "_chunk"]).select(
        *df.columns, (F.col("_local") + F.col("_before")).alias(name)
    )


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach group totals by a partial aggregate and an equi join (splittable under skew, unlike a window)."""
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return _joined(df, sums, keys)
