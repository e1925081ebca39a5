"""The three Silver aggregates.

Each reads two or three columns of the purchase lines and aggregates them on the
map side, so what is shuffled is one row per key and task, however many lines a
single product or market holds. Spellings that differ in case, accents or trailing
spaces name the same thing; they are merged after the binary aggregation, on
spellings rather than lines, because grouping on a collated column needs a sort.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import exact_ratio
from tillroll.functions.text import NAME_COLLATION
from tillroll.operators.gaps import day_blocks, merge_blocks


def as_of_date(as_of: date | str | None) -> Column:
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def product_parts(purchases: DataFrame, *by: str) -> DataFrame:
    """Sums and extremes per product, and per value of ``by``: what adds up to Silver."""
    price, day = F.col("product_price"), F.col("purchase_date")
    return purchases.groupBy(*by, "product_id").agg(
        F.count("*").alias("lines"),
        F.count(day).alias("dated"),
        F.count(price).alias("priced"),
        F.sum(price).alias("spent"),
        F.min(price).alias("low"),
        F.max(price).alias("high"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def _added_up(parts: DataFrame, key: str | Column, *more: Column) -> DataFrame:
    return parts.groupBy(key).agg(
        *more,
        *[F.sum(c).alias(c) for c in ("lines", "dated", "priced")],
        F.sum("spent").cast("decimal(20,2)").alias("spent"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    )


def product_stats(
    purchases: DataFrame, as_of: date | str | None = None, collation: str | None = NAME_COLLATION
) -> DataFrame:
    """Interval and price statistics per product."""
    return products_of_names(product_parts(purchases), as_of, collation)


def products_of_parts(
    parts: DataFrame, as_of: date | str | None = None, collation: str | None = NAME_COLLATION
) -> DataFrame:
    """The same from ``product_parts`` of any division of the lines."""
    return products_of_names(_added_up(parts, "product_id"), as_of, collation)


def products_of_names(
    per_name: DataFrame, as_of: date | str | None, collation: str | None
) -> DataFrame:
    """From one row per spelling. The gaps between consecutive dates add up to last minus first,
    so the average gap needs neither a window nor a sort."""
    if collation:
        # Dealt out by collation before they are sorted by it: once, not on both sides.
        same = F.collate("product_id", collation)
        dealt = per_name.withColumn("same_name", same).repartition("same_name")
        per_name = _added_up(dealt, "same_name", F.min("product_id").alias("product_id")).drop(
            "same_name"
        )
    money = "decimal(10,2)"
    return per_name.select(
        "product_id",
        F.col("last_day").alias("last_purchase_date"),
        exact_ratio(F.date_diff("last_day", "first_day"), F.col("dated") - 1)
        .cast(money)
        .alias("avg_days_purchase"),
        exact_ratio(F.col("spent"), F.col("priced")).cast(money).alias("avg_product_price"),
        F.round("low", 2).cast(money).alias("min_product_price"),
        F.round("high", 2).cast(money).alias("max_product_price"),
        F.col("lines").alias("total_purchases"),
        F.date_diff(as_of_date(as_of), "last_day").cast(money).alias("days_last_purchase"),
    )


def market_stats(purchases: DataFrame, collation: str | None = NAME_COLLATION) -> DataFrame:
    """Spend, visits (distinct days) and spend per visit of each market.

    Days are counted as bits of 64-day blocks, which merge over tasks and spellings.
    """
    return markets_of_blocks(market_parts(purchases), collation)


def market_parts(purchases: DataFrame, *by: str) -> DataFrame:
    """Spend and visited days per market and 64 days, and per value of ``by``."""
    return day_blocks(purchases, [*by, "market_id"], F.sum("product_price").alias("spent"))


def markets_of_parts(parts: DataFrame, collation: str | None = NAME_COLLATION) -> DataFrame:
    """``market_stats`` from ``market_parts`` of any division of the lines."""
    blocks = merge_blocks(parts, ["market_id"], F.sum("spent").alias("spent"))
    return markets_of_blocks(blocks, collation)


def markets_of_blocks(blocks: DataFrame, collation: str | None) -> DataFrame:
    key, names = "market_id", []
    if collation:
        key, names = "same_name", [F.min("market_id").alias("market_id")]
        same = F.collate("market_id", collation).alias(key)
        blocks = merge_blocks(blocks, [same], F.sum("spent").alias("spent"), *names)
    per_market = blocks.groupBy(key).agg(
        F.sum("spent").alias("spent"),
        F.sum(F.coalesce(F.bit_count("days"), F.lit(0))).alias("visit_count"),
        F.max("last").alias("last"),
        *names,
    )
    return per_market.select(
        "market_id",
        F.round("spent", 2).cast("decimal(20,2)").alias("total_spent"),
        exact_ratio(F.col("spent"), F.col("visit_count")).alias("avg_ticket"),
        "visit_count",
        F.date_from_unix_date("last").alias("last_visit"),
    )


def monthly_parts(purchases: DataFrame, *by: str) -> DataFrame:
    month = F.date_format("purchase_date", "yyyy-MM").alias("year_month")
    return purchases.groupBy(*by, month).agg(
        F.sum("product_price").alias("spent"),
        F.count("*").alias("item_count"),
        F.count("product_price").alias("priced"),
    )


def months_of_parts(parts: DataFrame) -> DataFrame:
    """``monthly_spending`` from ``monthly_parts`` of any division of the lines."""
    sums = [F.sum(c).alias(c) for c in ("spent", "item_count", "priced")]
    return _months(parts.groupBy("year_month").agg(*sums))


def monthly_spending(purchases: DataFrame) -> DataFrame:
    return _months(monthly_parts(purchases))


def _months(sums: DataFrame) -> DataFrame:
    return sums.select(
        "year_month",
        F.round("spent", 2).cast("decimal(20,2)").alias("total_spent"),
        "item_count",
        exact_ratio(F.col("spent"), F.col("priced")).cast("decimal(10,2)").alias("avg_price"),
    )
