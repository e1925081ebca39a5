"""How soon products are bought again: cumulative share of repurchases by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.gaps import block_gaps, day_blocks, merge_blocks

TOTAL = "Total"
MAX_DAYS = 60


def market_blocks(purchases: DataFrame) -> DataFrame:
    """Days and lines per market and product, from which everything here is computed."""
    return day_blocks(purchases, ["market_id", "product_id"])


def gap_histogram(blocks: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """(scope, is_whole, gap, n) for the whole set and each market; longer gaps share one bar.

    The whole set counts gaps between purchases of a product anywhere, a market only
    those within it, so one is not the sum of the others. ``is_whole`` tells the whole set
    from a market that bears its name.
    """
    overall = block_gaps(merge_blocks(blocks, ["product_id"]), ["product_id"])
    by_market = block_gaps(blocks, ["market_id", "product_id"])
    gaps = overall.select(
        F.lit(TOTAL).alias("scope"), F.lit(True).alias("is_whole"), "gap", "n"
    ).unionByName(
        by_market.select(F.col("market_id").alias("scope"), F.lit(False).alias("is_whole"), "gap", "n")
    )
    bar = F.least("gap", F.lit(max_days + 1))
    return gaps.groupBy("scope", "is_whole", bar.alias("gap")).agg(F.sum("n").alias("n"))


def recurrence_curve(purchases: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """(scope, is_whole, days, cumulative_pct) for days 0..max_days of scopes with a gap."""
    return curve_of(market_blocks(purchases), max_days)


def curve_of(blocks: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    per_scope = (
        gap_histogram(blocks, max_days)
        .groupBy("scope", "is_whole")
        .agg(
            F.sum("n").alias("total"),
            # At most max_days + 2 bars per scope.
            F.collect_list(F.struct("gap", "n")).alias("bars"),
        )
    )
    spine = per_scope.select(
        "scope",
        "is_whole",
        "total",
        "bars",
        F.explode(F.sequence(F.lit(0), F.lit(max_days))).alias("days"),
    )
    reached = F.aggregate(
        F.col("bars"),
        F.lit(0).cast("bigint"),
        lambda sum_, bar: sum_ + F.when(bar["gap"] <= F.col("days"), bar["n"]).otherwise(F.lit(0)),
    )
    return spine.select(
        "scope",
        "is_whole",
        "days",
        (reached.cast("double") / F.col("total").cast("double")).alias("cumulative_pct"),
    )


def median_repurchase_days(curve: DataFrame) -> DataFrame:
    """One row: the first day at which half of all repurchases have happened, or null."""
    reached = curve.where(F.col("is_whole") & (F.col("cumulative_pct") >= 0.5))
    return reached.agg(F.min("days").cast("double").alias("median_days"))


def market_frequency(purchases: DataFrame, weight: str | None = None) -> DataFrame:
    """Lines per market, the busiest first; ``weight`` names a column of line counts."""
    n = F.count("*") if weight is None else F.sum(weight)
    return (
        purchases.groupBy("market_id")
        .agg(n.alias("lines"))
        .orderBy(F.desc("lines"), "market_id")
    )


def default_scopes(blocks: DataFrame, curve: DataFrame, top: int = 3) -> DataFrame:
    """The whole set plus the busiest markets that have a curve, at most top + 1 rows."""
    markets = (
        market_frequency(blocks, "n")
        .withColumnRenamed("market_id", "scope")
        .join(curve.where(~F.col("is_whole")).select("scope").distinct(), "scope", "left_semi")
        .orderBy(F.desc("lines"), "scope")
        .limit(top)
        .select("scope", F.lit(False).alias("is_whole"))
    )
    whole = curve.sparkSession.range(1).select(
        F.lit(TOTAL).alias("scope"), F.lit(True).alias("is_whole")
    )
    return whole.unionByName(markets)


def curve_for_scopes(
    purchases: DataFrame, scopes: list[str] | None = None, max_days: int = MAX_DAYS
) -> DataFrame:
    blocks = market_blocks(purchases)
    curve = curve_of(blocks, max_days)
    if scopes is not None:
        return curve.where(F.col("scope").isin(*scopes))
    chosen = F.broadcast(default_scopes(blocks, curve))
    return curve.join(chosen, ["scope", "is_whole"], "left_semi")


def scope_list(curve: DataFrame) -> DataFrame:
    """Distinct scopes, the whole set first."""
    scopes = curve.select("scope", "is_whole").distinct()
    return scopes.orderBy(F.desc("is_whole"), "scope").select("scope")
