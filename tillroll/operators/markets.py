"""Market views over the Silver aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import market_bucket, market_key


def as_doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def market_share(markets: DataFrame) -> DataFrame:
    """Markets by spend, each with its share of all spend (0 when nothing was spent)."""
    total = markets.agg(F.sum("total_spent")).scalar()
    share = F.when(total == 0, 0.0).otherwise(
        F.col("total_spent").cast("double") / F.nullif(total.cast("double"), F.lit(0.0))
    )
    return markets.withColumn("share", share).orderBy(F.desc("total_spent"), "market_id")


def market_tickets(markets: DataFrame) -> DataFrame:
    return markets.orderBy(F.desc("avg_ticket"), "market_id")


def market_totals(markets: DataFrame) -> DataFrame:
    """One row: spend, visits, spend per visit (0 without visits), most visited market."""
    spent, visits = F.sum("total_spent"), F.sum("visit_count")
    return markets.agg(
        F.coalesce(spent, F.lit(0)).cast("double").alias("total_spent"),
        F.coalesce(visits, F.lit(0)).alias("visits"),
        F.coalesce(
            spent.cast("double") / F.nullif(visits, F.lit(0)).cast("double"), F.lit(0.0)
        ).alias("avg_ticket"),
        most_by("market_id", "visit_count").alias("most_visited"),
    )


def most_by(label: str, value: str):
    """Label with the largest value, the first label in order on a tie.

    min over (negated value, label) gives that in one aggregate.
    """
    return F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l")))["l"]


def market_buckets(markets: DataFrame) -> DataFrame:
    """Stable presentation bucket of every market and of the whole set."""
    names = markets.select("market_id")
    return names.select(
        "market_id",
        market_key("market_id").alias("market_key"),
        market_bucket("market_id").alias("bucket"),
    )
