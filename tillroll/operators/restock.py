"""What to buy: products past their usual interval, and those soon to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_buy_flag(products: DataFrame) -> DataFrame:
    """Statistics as doubles plus ``buy``: more days have gone by than usual."""
    numbers = (
        "avg_days_purchase",
        "avg_product_price",
        "min_product_price",
        "max_product_price",
        "days_last_purchase",
    )
    due = F.col("days_last_purchase") > F.col("avg_days_purchase")
    return products.withColumns({c: F.col(c).cast("double") for c in numbers}).withColumn(
        "buy", F.coalesce(due, F.lit(False))
    )


def due_list(products: DataFrame) -> DataFrame:
    """What has run past its interval, by how many times; ``overdue_days`` is the difference."""
    days, usual = F.col("days_last_purchase"), F.col("avg_days_purchase")
    return (
        products.where(F.col("buy") & (usual > 0))
        .withColumn("overdue_days", days - usual)
        .orderBy(F.desc(days / usual), "product_id")
        .select(
            "product_id",
            "last_purchase_date",
            "days_last_purchase",
            "avg_days_purchase",
            "overdue_days",
            "avg_product_price",
            "total_purchases",
        )
    )


def upcoming(products: DataFrame, horizon: int = 7) -> DataFrame:
    """What reaches its interval between now and ``horizon`` days on."""
    return (
        products.where(~F.col("buy"))
        .select(
            "product_id",
            (F.col("avg_days_purchase") - F.col("days_last_purchase")).alias("due_in_days"),
        )
        .where(F.col("due_in_days").between(0, horizon))
        .orderBy("due_in_days", "product_id")
    )


def restock_progress(
    products: DataFrame, filter_days: int = 30, show_all: bool = False
) -> DataFrame:
    """Share of the usual interval gone by, in percent, at most 150; 0 without one."""
    shown = products if show_all else products.where(F.col("days_last_purchase") <= filter_days)
    usual = F.nullif("avg_days_purchase", F.lit(0.0))
    # least() skips nulls, so the null has to be caught before it.
    share = F.when(usual.isNull(), 0.0).otherwise(
        F.least(F.col("days_last_purchase") / usual * 100, F.lit(150.0))
    )
    return (
        shown.withColumn("purchase_progress", share)
        .orderBy(F.desc("buy"), F.desc("days_last_purchase"), "product_id")
        .select(
            "product_id",
            "days_last_purchase",
            "avg_days_purchase",
            "avg_product_price",
            "total_purchases",
            "last_purchase_date",
            "purchase_progress",
        )
    )


def due_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count_if("buy").alias("due"), F.count("*").alias("products"))


def ranked_top(df: DataFrame, label: str, value: str, top: int = 12) -> DataFrame:
    """The ``top`` largest rows by value, the label breaking ties."""
    return df.orderBy(F.desc(value), label).limit(top)


def table_page(df: DataFrame, max_rows: int = 15) -> DataFrame:
    """First rows of an ordered view, each with the number of rows of the whole view."""
    total = df.agg(F.count("*")).scalar()
    return df.limit(max_rows).withColumn("total_rows", total)
