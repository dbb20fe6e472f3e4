"""Ranges as equality keys: intervals cut into nested ranges of days, bands as neighbouring buckets, and ordered scans laid
in blocks. All three let a key that holds most rows be many tasks' work, and none compares all pairs of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of 4^level days, counted from the first of January of the year 1; the last level is one range of all days.
LEVELS = 12
_DAYS = 1 << 2 * (LEVELS - 1)
_ORIGIN = "0001-01-01"


def day_number(day: Column, if_null: int | None = None) -> Column:
    """Days from 0001-01-01 to a date of the years 1 to 9999."""
    n = F.datediff(day, F.lit(_ORIGIN).cast("date")).cast("long")
    return n if if_null is None else F.coalesce(n, F.lit(if_null).cast("long"))


def cut(df: DataFrame, first: Column, last: Column, name: str = "_r") -> DataFrame:
    """Rows once for each range that their closed interval of dates is made of: at most six a level, some thirty for
    ten years. Null ends are open; an interval that ends before it starts has no ranges."""
    a, e = day_number(first, 0), day_number(F.date_add(last, 1), _DAYS)
    shift = lambda by, x, n: F.call_function(f"shift{by}", x, n)
    width = F.col("_level") * 2
    # a row a level first, so that all levels are one short expression
    laid = df.withColumns({"_a": a, "_e": e}).where("_a < _e").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    laid = laid.withColumns({"_low": shift("right", F.col("_a") + shift("left", F.lit(1).cast("long"), width) - 1, width), "_high": shift("right", F.col("_e"), width)}).where("_low < _high")
    # what the next level's whole ranges leave over on the left and on the right
    left = F.when(F.col("_level") == LEVELS - 1, F.col("_high")).otherwise(F.least(F.shiftright(F.col("_low") + 3, 2) * 4, F.col("_high")))
    laid = laid.withColumn("_left", left).withColumn("_right", F.greatest(F.shiftright(F.col("_high"), 2) * 4, F.col("_left")))

    def part(low: str, high: str) -> Column:
        first, last = (F.col(c) + shift("left", F.col("_level").cast("long"), F.lit(32)) for c in (low, high))
        return F.when(F.col(low) < F.col(high), F.sequence(first, F.greatest(first, last - 1))).otherwise(F.array().cast("array<bigint>"))

    return laid.withColumn(name, F.explode(F.concat(part("_low", "_left"), part("_right", "_high")))).select(*df.columns, name)


def holding(day: Column) -> Column:
    """The ranges that hold a day, one a level; a null day is only in the range of all days."""
    n = day_number(day)
    return F.array_compact(F.array(*[F.shiftright(n, 2 * level) + (level << 32) for level in range(LEVELS - 1)], F.lit((LEVELS - 1) << 32)))


def bucket(value: Column, width: int) -> Column:
    """The bucket of ``width`` that a whole number falls in."""
    return F.floor(value / float(width)).cast("long")


def buckets(low: Column, high: Column, width: int) -> Column:
    """The buckets that the numbers from ``low`` to ``high`` fall in: two at most where the band is as wide as a bucket."""
    return F.sequence(bucket(low, width), bucket(high, width))


def with_halo(df: DataFrame, keys: list[str], order: list[str], n: int, block: Column) -> DataFrame:
    """Rows with their ``_block``, and before each block of a key the n - 1 rows that come before it (``_own`` is false).

    Windows of n rows over (keys, _block) in ``order`` then see what windows over keys would. ``block`` must not fall as
    ``order`` rises. What a block hands on is at most n - 1 rows, found before the shuffle; empty blocks don't exist, so
    n - 1 blocks back are enough.
    """
    rows = df.withColumn("_block", block)
    last = Window.partitionBy(*keys, "_block").orderBy(*[F.col(c).desc() for c in order])
    tails = rows.withColumn("_at", F.row_number().over(last)).where(F.col("_at") < n)
    ends = tails.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_at", F.struct(*df.columns).alias("row"))), lambda x, y: y["_at"] - x["_at"]).alias("_rows"))
    back = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-(n - 1), -1)
    before = F.flatten(F.collect_list("_rows").over(back))
    carried = ends.select("_block", before.alias("_rows")).select("_block", F.explode(F.slice("_rows", F.greatest(F.size("_rows") - (n - 2), F.lit(1)), n - 1)).alias("_x"))
    handed = carried.select("_x.row.*", "_block", F.lit(False).alias("_own"))
    return rows.withColumn("_own", F.lit(True)).unionByName(handed)


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """Rows numbered from 1 within their keys, in ``order``: numbered within blocks, plus the rows of the blocks before,
    for which one row a block is counted. ``block`` must not fall as ``order`` rises."""
    rows = df.withColumn("_block", block)
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    back = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # counted by their own numbers: the rows are read and shuffled into blocks once
    counts = inside.groupBy(*keys, "_block").agg(F.max(name).alias("_n"))
    counts = counts.select(*[F.col(k).alias("_of_" + k) for k in [*keys, "_block"]], F.coalesce(F.sum("_n").over(back), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col("_of_" + k)) for k in [*keys, "_block"]]
    return inside.join(counts, on).select(*df.columns, (F.col(name) + F.col("_before")).alias(name))
