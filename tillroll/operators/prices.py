"""Price views: alerts, history, spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numbers import pct_change

ALERT_THRESHOLD = 0.15
ALERT_LIMIT = 15


def last_and_prior(purchases: DataFrame, price_col: str = "product_price") -> DataFrame:
    """Last price of each product bought twice or more, and the mean of all before it.

    Lines on the last day are told apart by ``id``. One aggregate does it: each task
    passes on one row per product, so no product is too large and no line is shuffled.
    """
    # Whole cents, so that sums are exact and do not depend on the order of the lines.
    price = F.col(price_col).cast("decimal(18,2)")
    return (
        purchases.groupBy("product_id")
        .agg(
            F.max_by(price, F.struct("purchase_date", "id")).alias("last_price"),
            F.sum(price).alias("spent"),
            F.count(price).alias("n"),
            F.max("purchase_date").alias("last_purchase_date"),
        )
        .where("n >= 2")
        .select(
            "product_id",
            F.col("last_price").cast("double").alias("last_price"),
            (
                (F.col("spent") - F.col("last_price")).cast("double")
                / (F.col("n") - 1).cast("double")
            ).alias("prior_avg_price"),
            "last_purchase_date",
        )
    )


def price_alerts(
    purchases: DataFrame,
    threshold: float = ALERT_THRESHOLD,
    limit: int | None = ALERT_LIMIT,
    price_col: str = "product_price",
) -> DataFrame:
    """Products whose last price is more than ``threshold`` above the earlier mean."""
    alerts = (
        last_and_prior(purchases, price_col)
        .withColumn("variation_pct", pct_change(F.col("last_price"), F.col("prior_avg_price")))
        .where(F.col("variation_pct") > threshold)
        .select(
            "product_id", "last_price", "prior_avg_price", "variation_pct", "last_purchase_date"
        )
        .orderBy(F.desc("variation_pct"), "product_id")
    )
    return alerts if limit is None else alerts.limit(limit)


def price_history(purchases: DataFrame, product_id: str | None) -> DataFrame:
    """Every line of one product by date; no rows without a product."""
    wanted = F.col("product_id") == product_id if product_id else F.lit(False)
    return purchases.where(wanted).orderBy("purchase_date", "id")


def price_evolution(purchases: DataFrame, products: list[str] | None = None) -> DataFrame:
    """Lines of the chosen products; by default the three first names in order."""
    if products is not None:
        return purchases.where(F.col("product_id").isin(*products))
    first = purchases.select("product_id").distinct().orderBy("product_id").limit(3)
    return purchases.join(F.broadcast(first), "product_id", "left_semi")


def price_summary(products: DataFrame, product_id: str | None) -> DataFrame:
    wanted = F.col("product_id") == product_id if product_id else F.lit(False)
    return products.where(wanted).limit(1)


def price_spread(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        "avg_product_price",
        "min_product_price",
        "max_product_price",
        "total_purchases",
        (F.col("max_product_price") - F.col("min_product_price")).alias("spread"),
    ).orderBy(F.desc("spread"), "product_id")
