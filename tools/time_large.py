"""Time operators over many generated lines of which a third are one product at one market.

    python tools/time_large.py [millions of lines, default 15]

Prints one JSON line of warm seconds. The lines go to the session's shared folder.
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tillroll.operators import catalog, cleaning, prices, recurrence, silver  # noqa: E402
from tillroll.session import staged  # noqa: E402


def lines(spark: SparkSession, n: int):
    number = F.xxhash64("id")
    hot = F.pmod(number, F.lit(3)) == 0
    return spark.range(0, n, 1, 64).select(
        "id",
        F.date_add(F.lit("2020-01-01"), F.pmod(number, F.lit(2000)).cast("int")).alias("purchase_date"),
        F.when(hot, "Product 0")
        .otherwise(F.concat(F.lit("Product "), F.pmod(number, F.lit(200_000))))
        .alias("product_id"),
        (F.pmod(number, F.lit(90_000)) / 100 + 1).cast("decimal(10,2)").alias("product_price"),
        F.when(hot, "Market 0")
        .otherwise(F.concat(F.lit("Market "), F.pmod(number, F.lit(5000))))
        .alias("market_id"),
    )


def main() -> None:
    n = int(float(sys.argv[1]) * 1e6) if len(sys.argv) > 1 else 15_000_000
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    stored = staged(lines(spark, n), "large")
    known = stored.select("product_id").distinct().withColumn("product_id", F.upper("product_id"))
    raw = stored.select(
        "id", *[F.col(c).cast("string").alias(c) for c in stored.columns if c != "id"],
        F.lit("").alias("quantity"), F.lit("").alias("unit_price"),
    )
    jobs = {
        "product_stats": silver.product_stats(stored, "2026-01-01"),
        "market_stats": silver.market_stats(stored),
        "monthly_spending": silver.monthly_spending(stored),
        "price_alerts": prices.price_alerts(stored),
        "recurrence_curve": recurrence.recurrence_curve(stored),
        "match_known_products": catalog.match_known_products(stored, known),
        "clean_purchases": cleaning.clean_purchases(raw),
    }
    seconds = {}
    for name, df in jobs.items():
        for _ in range(2):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 2)
    print(json.dumps({"lines": n, "cpus": 8, "seconds": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
