"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tillroll.operators import catalog, cleaning, edits, gaps, prices, recurrence, silver
from tillroll.plans import registry, testbed
from tillroll.plans.registry import QUERIES
from tillroll.session import fresh_path

SF = "/root/testdata/sf0.001"
# Queries that write tables first; their plans only read the result.
WRITERS = {
    "scan_raw", "ingest_to_raw", "scan_bronze", "scan_bronze_editable", "append_bronze",
    "raw_to_bronze_stream", "refresh_layers", "scan_product_stats", "scan_market_stats",
    "scan_monthly_spending", "refresh_silver", "apply_edits_to_layers", "migrate_legacy",
    "scan_purchases_csv", "scan_receipt_json", "export_due_csv", "receipt_rejects",
    "silver_after_changes", "evolve_tables",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, golden, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "p")
    wide = golden.withColumns({c: F.lit("x") for c in ("access_key", "nfce_url", "unused")})
    wide.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_pair_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_line_level_aggregates_hash_and_never_sort(lines):
    for df in (
        silver.product_stats(lines, "2026-02-10", collation=None),
        silver.market_stats(lines, collation=None),
        silver.monthly_spending(lines),
    ):
        text = plan(df)
        assert "SortAggregate" not in text and "Window" not in text and "partial_" in text


def test_alerts_shuffle_once_after_partials(lines):
    text = plan(prices.last_and_prior(lines))
    assert text.count("Exchange") == 1 and "partial_max_by" in text and "Window" not in text


def test_windows_only_see_aggregates(lines):
    keys = ["product_id"]
    for df in (
        recurrence.gap_histogram(recurrence.market_blocks(lines)),
        gaps.purchase_gaps(gaps.daily_counts(lines, keys), keys),
    ):
        text = plan(df)
        for window in re.finditer(r"Window \[", text):
            assert "partial_" in text[window.end() :]
        assert "SinglePartition" not in text and "SortAggregate" not in text


def test_scans_read_only_what_is_used(lines):
    schema = re.search(r"ReadSchema: struct<(.*)>", plan(silver.market_stats(lines, None))).group(1)
    read = set(re.findall(r"(\w+):", schema))
    assert read == {"market_id", "purchase_date", "product_price"}
    history = plan(prices.price_history(lines, "Leite"))
    assert "EqualTo(product_id,Leite)" in history


def test_alert_limit_is_a_top_k(lines):
    assert "TakeOrderedAndProject" in plan(prices.price_alerts(lines))


def test_cleaning_stays_within_what_the_jit_compiles(spark, tmp_path):
    fields = "purchase_date product_id product_price quantity unit_price market_id access_key nfce_url"
    raw = spark.range(1).select("id", *[F.lit("1").alias(c) for c in [*fields.split(), "ingest_id"]])
    raw.write.parquet(str(tmp_path / "raw"))
    cleaned = cleaning.clean_purchases(spark.read.parquet(str(tmp_path / "raw")))
    stored = cleaned.withColumn("rejected", F.col("reject_reason").isNotNull())
    stages = stored._jdf.queryExecution().debug().codegenToSeq()
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    # The JVM leaves methods over 8000 bytes to the interpreter.
    assert sizes and max(sizes) < 8000


def test_a_hot_product_is_split_in_name_matching(spark):
    """With broadcasts off and low thresholds, adaptive execution divides the hot product."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        name = F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("P"), F.col("id")))
        lines = spark.range(0, 60_000, 1, 16).select("id", name.alias("product_id"))
        known = spark.createDataFrame([("HOT",), ("P1",)], "product_id string")
        matched = catalog.match_known_products(lines, known)
        assert matched.where("matched_name = 'HOT'").count() == 20_000
        matched.collect()
        assert "skewed" in matched._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edits_need_one_join_of_two_inputs(spark):
    columns = "id long, " + ", ".join(f"{c} string" for c in edits.EDITABLE)
    original, edited = (spark.createDataFrame([], columns) for _ in range(2))
    plan = edits.apply_purchase_edits(original, edited)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "FullOuter" in plan and plan.count("LogicalRDD") == 2


def test_a_filter_on_cleaned_lines_parses_no_text_again(spark):
    cleaned = cleaning.clean_purchases(testbed.raw_purchases(spark, SF))
    names = ("regexp_replace", "RLIKE", "try_cast", "rint")
    for chosen in (cleaning.accepted(cleaned), cleaning.rejected(cleaned)):
        whole, part = (
            df._jdf.queryExecution().optimizedPlan().toString() for df in (cleaned, chosen)
        )
        assert all(part.count(n) <= whole.count(n) for n in names)
        assert "Generate inline" in part


@pytest.mark.parametrize("name", ["receipt_items", "oversized_amounts", "raw_to_bronze"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, name, capsys):
    """HotSpot leaves methods of more than 8,000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        QUERIES[name](spark, SF).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
    assert sizes and max(map(int, sizes)) < 8000


def test_raw_lines_are_dealt_out_before_they_have_texts(spark):
    dealt = plan(testbed.raw_purchases(spark, SF, dealt=True))
    assert "Exchange hashpartitioning(l_orderkey" in dealt
    assert "hashpartitioning(id" not in plan(registry._raw(spark, SF))


def test_names_alike_meet_without_windows_over_shared_runs(spark):
    names = spark.createDataFrame([("old ring 947",)], "plain string")
    found = plan(catalog.similar_names(names, names))
    assert "xxhash64" in found and "Window" not in found


def test_matching_names_neither_reads_nor_broadcasts_once_a_use(spark):
    """Lines get their names from a table small enough to be broadcast: it is, once for all uses
    of the known names, the spellings and the lines together."""
    parts = fresh_path(spark, "parts")
    spark.range(300).selectExpr("id AS part", "concat('blue ring ', id) AS product_id").write.parquet(parts)
    bought = spark.range(900).selectExpr("id", "id % 300 AS part").repartition(3)
    lines = bought.join(spark.read.parquet(parts), "part").select("id", "product_id")
    known = lines.groupBy("product_id").agg(F.count("*").alias("total_purchases"))
    known = known.where("total_purchases > 0").withColumn("product_id", F.initcap("product_id"))
    matched = catalog.match_similar_products(lines, known)
    assert matched.where("matched_by = 'same'").count() == 900
    matched.collect()
    final = plan(matched).split("== Initial Plan ==")[0]
    made = [x for x in final.splitlines() if "BroadcastExchange" in x and "Reused" not in x]
    assert len([x for x in made if "bigint" in x]) == 1 and len(made) <= 3
