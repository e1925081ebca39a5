"""Month views and headline figures over the Silver aggregates.

Windows without a partition run only here, over one row per calendar month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillroll.functions.numbers import pct_change, spending_tone
from tillroll.operators.markets import most_by


def _by_month():
    return W.orderBy("year_month")


def monthly_trend(monthly: DataFrame, window: int = 3) -> DataFrame:
    """Months in order with the mean spend of the last ``window`` rows."""
    recent = _by_month().rowsBetween(1 - window, W.currentRow)
    mean = F.sum("total_spent").over(recent).cast("double") / F.count("total_spent").over(recent)
    return monthly.withColumn("rolling_avg", mean).orderBy("year_month")


def monthly_detail(monthly: DataFrame) -> DataFrame:
    return monthly.orderBy(F.desc("year_month"))


def with_changes(monthly: DataFrame) -> DataFrame:
    """Each month with the change of its figures against the row before."""

    def change(name: str):
        return pct_change(F.col(name), F.lag(name).over(_by_month()))

    return monthly.withColumns(
        {f"{c}_change": change(c) for c in ("total_spent", "item_count", "avg_price")}
    )


def month_over_month(monthly: DataFrame) -> DataFrame:
    """One row: the latest month, its changes and the tone of the spending change."""
    return (
        with_changes(monthly)
        .withColumn("tone", spending_tone(F.col("total_spent_change")))
        .orderBy(F.desc("year_month"))
        .limit(1)
    )


def latest_and_previous(monthly: DataFrame) -> DataFrame:
    return monthly.orderBy(F.desc("year_month")).limit(2)


def latest_purchase(purchases: DataFrame) -> DataFrame:
    return purchases.agg(F.max("purchase_date").alias("latest_purchase"))


def _month_figures(monthly: DataFrame) -> DataFrame:
    """One row of month figures; months are few, so they may meet in one row."""
    latest = F.struct("year_month", "total_spent", "total_spent_change")
    return (
        with_changes(monthly)
        .agg(
            F.max(latest).alias("latest"),
            F.sum("total_spent").cast("double").alias("total_spent"),
            F.count("*").alias("months"),
            F.array_sort(F.collect_list(F.struct("year_month", "total_spent"))).alias("series"),
        )
        .select(
            F.col("latest.year_month").alias("latest_month"),
            F.col("latest.total_spent").cast("double").alias("latest_spent"),
            F.col("latest.total_spent_change").alias("change"),
            "total_spent",
            "months",
            "series",
        )
    )


def kpi_summary(products: DataFrame, markets: DataFrame, monthly: DataFrame) -> DataFrame:
    """One row of headline figures; a figure without data is null."""
    visits = markets.agg(
        F.struct(
            F.sum("visit_count").alias("visits"),
            (
                F.sum("total_spent").cast("double")
                / F.nullif(F.sum("visit_count"), F.lit(0)).cast("double")
            ).alias("avg_ticket"),
        ).alias("v")
    ).scalar()
    due = products.agg(
        F.struct(F.count_if("buy").alias("due"), F.count("*").alias("products")).alias("d")
    ).scalar()
    return (
        _month_figures(monthly)
        .withColumn("tone", spending_tone(F.col("change")))
        .withColumns({"v": visits, "d": due})
        .select(
            "latest_month",
            "latest_spent",
            "change",
            "tone",
            "total_spent",
            "months",
            "v.visits",
            "v.avg_ticket",
            "d.due",
            "d.products",
        )
    )


def kpi_header(products: DataFrame, markets: DataFrame, monthly: DataFrame) -> DataFrame:
    """One row: spend with its monthly series, favourite product and market, last purchase."""
    product = products.agg(
        F.struct(
            most_by("product_id", "total_purchases").alias("most_bought"),
            F.max("total_purchases").alias("purchases"),
            F.min("days_last_purchase").cast("double").alias("days_since_purchase"),
        ).alias("p")
    ).scalar()
    market = markets.agg(
        F.struct(
            most_by("market_id", "visit_count").alias("favourite_market"),
            F.max("visit_count").alias("visits"),
        ).alias("m")
    ).scalar()
    return (
        _month_figures(monthly)
        .withColumns({"p": product, "m": market})
        .select("total_spent", "change", "series", "p.*", "m.*")
    )
