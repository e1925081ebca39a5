"""Days between consecutive purchases, kept as weighted rows.

A product or market may hold a large share of all lines, so no window ever runs over
purchase lines: they are aggregated first, with partials before the shuffle. A day with
c lines of a key gives one gap to the key's previous day and c - 1 gaps of 0, which is
the same multiset a line-by-line lag gives.

Two aggregates lead there. ``daily_counts`` has a row per key and day, for when the day
of each gap matters. ``day_blocks`` has a row per key and 64 days, with the days as bits
of one integer: fixed-width, so a hash aggregate, and up to 64 times fewer rows to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_BLOCK_BITS = 6
_BLOCK_DAYS = 2**_BLOCK_BITS
_GAPS = "array<struct<gap:int,n:bigint>>"


def daily_counts(purchases: DataFrame, keys: list[str]) -> DataFrame:
    return purchases.groupBy(*keys, "purchase_date").agg(F.count("*").alias("n"))


def purchase_gaps(daily: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, purchase_date, gap, n); gap is null for the first line of a key."""
    previous = F.lag("purchase_date").over(W.partitionBy(*keys).orderBy("purchase_date"))
    first_of_day = _weighted(F.date_diff("purchase_date", previous), F.lit(1))
    same_day = _weighted(F.lit(0), F.col("n") - 1)
    return (
        daily.select(*keys, "purchase_date", F.array(first_of_day, same_day).alias("gaps"))
        .select(*keys, "purchase_date", F.inline("gaps"))
        .where("n > 0")
    )


def _weighted(gap: Column, n: Column) -> Column:
    return F.struct(gap.alias("gap"), n.cast("bigint").alias("n"))


def _bit_of(day: Column) -> Column:
    return day.bitwiseAND(_BLOCK_DAYS - 1)


def day_blocks(purchases: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, block, days, first, last, n): which of 64 days a key was bought on.

    ``more`` are further aggregates of the lines of a block. Lines without a date form a
    block of their own, which holds no day and gives no gap.
    """
    day = F.unix_date("purchase_date")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit_of(day))
    return purchases.groupBy(*keys, F.shiftright(day, _BLOCK_BITS).alias("block")).agg(
        F.bit_or(bit).alias("days"),
        F.min(day).alias("first"),
        F.max(day).alias("last"),
        F.count("*").alias("n"),
        *more,
    )


def merge_blocks(blocks: DataFrame, keys: list[str | Column], *more: Column) -> DataFrame:
    """Blocks of a coarser set of keys."""
    return blocks.groupBy(*keys, "block").agg(
        F.bit_or("days").alias("days"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("n").alias("n"),
        *more,
    )


def block_gaps(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap, n), several rows per gap: into a block, inside it, and on one day."""
    previous = F.lag("last").over(W.partitionBy(*keys).orderBy("block"))
    entering = _weighted(F.col("first") - previous, F.lit(1))
    same_day = _weighted(F.lit(0), F.col("n") - F.bit_count("days"))
    # Most blocks of rarely bought keys hold one day, and have no steps to work out.
    bought = F.when(
        F.col("first") < F.col("last"),
        F.filter(
            F.sequence("first", "last"), lambda day: F.bit_get(F.col("days"), _bit_of(day)) == 1
        ),
    )
    steps = F.zip_with(
        F.slice("bought", 2, F.lit(_BLOCK_DAYS)),
        F.slice("bought", 1, F.size("bought") - 1),
        lambda later, earlier: _weighted(later - earlier, F.lit(1)),
    )
    inside = F.when(F.col("bought").isNotNull(), steps).otherwise(F.array().cast(_GAPS))
    return (
        blocks.withColumns({"entering": entering, "same_day": same_day, "bought": bought})
        .select(*keys, F.inline(F.concat(F.array("entering", "same_day"), inside)))
        .where("gap IS NOT NULL AND n > 0")
    )


def recurrence_gaps(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap, n) over all repurchases."""
    return block_gaps(blocks, keys).groupBy(*keys, "gap").agg(F.sum("n").alias("n"))
