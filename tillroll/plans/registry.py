"""Queries over the order tables: one per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions import dates, numbers, receipts, text
from tillroll.operators import (
    catalog,
    cleaning,
    edits,
    gaps,
    markets,
    prices,
    receipts as whole,
    recurrence,
    restock,
    silver,
    trends,
)
from tillroll.plans import imports, testbed
from tillroll.plans.testbed import AS_OF
from tillroll.schemas import LATER_COLUMNS, evolve_purchases
from tillroll.session import fresh_path, staged
from tillroll.sources import purchases as files
from tillroll.sources.tables import Layers
from tillroll.streaming import bronze as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PRODUCT = "old ring 947"
_PRODUCT_COLUMNS = ("id", "purchase_date", "product_id", "product_price")
_MARKET_COLUMNS = ("purchase_date", "product_price", "market_id")


def published(df: DataFrame) -> DataFrame:
    """Types two engines write alike: doubles, 64-bit integers, ISO dates, ids as text."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            column = column.cast("string" if kind.scale == 0 else "double")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select([plain(f) for f in df.schema])


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return published(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


def _products(spark, d):
    lines = testbed.purchases(spark, d, ("purchase_date", "product_id", "product_price"))
    return silver.product_stats(lines, AS_OF)


def _flagged(spark, d):
    return restock.with_buy_flag(_products(spark, d))


def _markets(spark, d):
    return silver.market_stats(testbed.purchases(spark, d, _MARKET_COLUMNS))


def _monthly(spark, d):
    return silver.monthly_spending(
        testbed.purchases(spark, d, ("purchase_date", "product_price"))
    )


def _trip_lines(spark, d):
    return testbed.purchases(spark, d, ("purchase_date", "product_id", "market_id"))


def _curve(spark, d):
    return recurrence.recurrence_curve(_trip_lines(spark, d))


# --- Silver and what is read from it ---------------------------------------------


@query
def product_stats(spark, d):
    return _products(spark, d)


@query
def market_stats(spark, d):
    return _markets(spark, d)


@query
def monthly_spending(spark, d):
    return _monthly(spark, d)


@query
def buy_flag(spark, d):
    return _flagged(spark, d).select("product_id", "buy")


@query
def due_list(spark, d):
    return restock.due_list(_flagged(spark, d))


@query
def upcoming(spark, d):
    return restock.upcoming(_flagged(spark, d))


@query
def restock_progress(spark, d):
    return restock.restock_progress(_flagged(spark, d), filter_days=90)


@query
def restock_progress_all(spark, d):
    return restock.restock_progress(_flagged(spark, d), show_all=True)


@query
def due_count(spark, d):
    return restock.due_count(_flagged(spark, d))


@query
def price_spread(spark, d):
    return prices.price_spread(_products(spark, d))


@query
def price_summary(spark, d):
    return prices.price_summary(_products(spark, d), PRODUCT)


@query
def product_options(spark, d):
    return catalog.product_options(_products(spark, d))


@query
def known_products(spark, d):
    return catalog.known_products(_products(spark, d))


@query
def market_share(spark, d):
    return markets.market_share(_markets(spark, d))


@query
def market_tickets(spark, d):
    return markets.market_tickets(_markets(spark, d))


@query
def market_totals(spark, d):
    return markets.market_totals(_markets(spark, d))


@query
def market_buckets(spark, d):
    return markets.market_buckets(_markets(spark, d))


@query
def monthly_trend(spark, d):
    return trends.monthly_trend(_monthly(spark, d))


@query
def monthly_detail(spark, d):
    return trends.monthly_detail(_monthly(spark, d))


@query
def month_changes(spark, d):
    changed = trends.with_changes(_monthly(spark, d))
    return changed.withColumn("tone", numbers.spending_tone(F.col("total_spent_change")))


@query
def month_over_month(spark, d):
    return trends.month_over_month(_monthly(spark, d))


@query
def latest_and_previous(spark, d):
    return trends.latest_and_previous(_monthly(spark, d))


@query
def kpi_summary(spark, d):
    return trends.kpi_summary(_flagged(spark, d), _markets(spark, d), _monthly(spark, d))


@query
def kpi_header(spark, d):
    header = trends.kpi_header(_flagged(spark, d), _markets(spark, d), _monthly(spark, d))
    one = F.transform(
        "series", lambda m: F.concat_ws("=", m["year_month"], m["total_spent"].cast("string"))
    )
    return header.withColumn("series", F.array_join(one, ","))


@query
def ranked_overdue(spark, d):
    due = restock.due_list(_flagged(spark, d))
    return restock.ranked_top(due, "product_id", "overdue_days").select(
        "product_id", "overdue_days"
    )


@query
def ranked_spend(spark, d):
    shares = markets.market_share(_markets(spark, d))
    return restock.ranked_top(shares, "market_id", "total_spent").select(
        "market_id", "total_spent", "share"
    )


@query
def ranked_ticket(spark, d):
    return restock.ranked_top(_markets(spark, d), "market_id", "avg_ticket").select(
        "market_id", "avg_ticket"
    )


@query
def table_page(spark, d):
    return restock.table_page(restock.due_list(_flagged(spark, d)))


# --- Purchase lines ----------------------------------------------------------------


@query
def latest_purchase(spark, d):
    return trends.latest_purchase(testbed.purchases(spark, d, ("purchase_date",)))


@query
def price_history(spark, d):
    return prices.price_history(testbed.purchases(spark, d), PRODUCT)


@query
def price_evolution(spark, d):
    return prices.price_evolution(testbed.purchases(spark, d))


@query
def last_and_prior(spark, d):
    return prices.last_and_prior(testbed.purchases(spark, d, _PRODUCT_COLUMNS))


@query
def price_alerts(spark, d):
    return prices.price_alerts(testbed.purchases(spark, d, _PRODUCT_COLUMNS))


@query
def price_alerts_all(spark, d):
    return prices.price_alerts(testbed.purchases(spark, d, _PRODUCT_COLUMNS), limit=None)


@query
def purchase_gaps(spark, d):
    lines = testbed.purchases(spark, d, ("purchase_date", "product_id"))
    keys = ["product_id"]
    per_day = gaps.purchase_gaps(gaps.daily_counts(lines, keys), keys)
    return per_day.withColumnRenamed("gap", "days_between")


@query
def recurrence_gaps(spark, d):
    keys = ["market_id", "product_id"]
    return gaps.recurrence_gaps(gaps.day_blocks(_trip_lines(spark, d), keys), keys)


@query
def recurrence_curve(spark, d):
    return _curve(spark, d).drop("is_whole")


@query
def curve_with_market_total(spark, d):
    """One market bears the name of the whole set."""
    name = F.when(F.col("market_id") == "Supplier#000000001", "Total").otherwise(F.col("market_id"))
    return recurrence.recurrence_curve(_trip_lines(spark, d).withColumn("market_id", name))


@query
def curve_for_scopes(spark, d):
    return recurrence.curve_for_scopes(_trip_lines(spark, d)).drop("is_whole")


@query
def scope_list(spark, d):
    return recurrence.scope_list(_curve(spark, d))


@query
def median_repurchase_days(spark, d):
    return recurrence.median_repurchase_days(_curve(spark, d))


@query
def market_frequency(spark, d):
    return recurrence.market_frequency(testbed.purchases(spark, d, ("market_id",)))


# --- Cleaning ----------------------------------------------------------------------


def _raw(spark, d):
    """Raw lines dealt out evenly, as a stored table has them: the joins that make them here
    would otherwise leave all text work to the few tasks that read the order lines."""
    return testbed.raw_purchases(spark, d, dealt=True)


def _cleaned(spark, d):
    return cleaning.clean_purchases(_raw(spark, d))


_BRONZE_OUT = (
    "raw_id",
    "purchase_date",
    "product_id",
    "product_price",
    "quantity",
    "unit_price",
    "market_id",
    "access_key",
    "nfce_url",
)


@query
def raw_to_bronze(spark, d):
    return cleaning.accepted(_cleaned(spark, d)).select(*_BRONZE_OUT)


@query
def drop_invalid_price(spark, d):
    return cleaning.rejected(_cleaned(spark, d)).select("raw_id", "reason")


@query
def clean_name(spark, d):
    raw = testbed.raw_purchases(spark, d)
    return raw.select("id", text.clean_name("product_id").alias("product_id"))


@query
def parse_purchase_date(spark, d):
    raw = testbed.raw_purchases(spark, d)
    return raw.select("id", dates.parse_purchase_date("purchase_date").alias("purchase_date"))


@query
def coerce_number(spark, d):
    raw = testbed.raw_purchases(spark, d)
    names = ("product_price", "quantity", "unit_price")
    return raw.select("id", *[numbers.coerce_number(c).alias(c) for c in names])


@query
def reconcile_amounts(spark, d):
    raw = testbed.raw_purchases(spark, d)
    amounts = [numbers.coerce_number(c) for c in ("quantity", "unit_price", "product_price")]
    return raw.select("id", *[c.alias(n) for n, c in cleaning.reconcile_amounts(*amounts).items()])


@query
def clean_receipt_meta(spark, d):
    raw = testbed.raw_purchases(spark, d)
    return raw.select("id", *[text.receipt_meta(c).alias(c) for c in ("access_key", "nfce_url")])


@query
def derive_total_on_ingest(spark, d):
    lines = testbed.purchases(spark, d, ("id", "quantity", "unit_price"))
    return cleaning.derive_total(lines).select("id", "product_price")


@query
def is_blank_purchase(spark, d):
    edited = testbed.edited_lines(spark, d)
    return edited.groupBy(cleaning.is_blank_purchase().alias("blank")).agg(F.count("*").alias("n"))


@query
def conform_receipt_columns(spark, d):
    raw = testbed.raw_purchases(spark, d).drop("access_key", "nfce_url")
    conformed = cleaning.conform_receipt(raw)
    # The first eight columns are fixed; the id, an extra column, comes after them.
    return conformed.select(
        "purchase_date", "quantity", "unit_price", "product_price", "access_key", "nfce_url", "id"
    )


@query
def unprocessed_raw(spark, d):
    raw = _raw(spark, d)
    taken = cleaning.accepted(_cleaned(spark, d))
    return cleaning.unprocessed_raw(raw, taken).select("id")


@query
def distinct_processed_ids(spark, d):
    taken = cleaning.accepted(_cleaned(spark, d)).select("raw_id")
    return cleaning.distinct_processed_ids(taken, taken)


@query
def raw_row_count(spark, d):
    return testbed.raw_purchases(spark, d).agg(F.count("*").alias("n"))


@query
def match_known_products(spark, d):
    raw = testbed.raw_purchases(spark, d).select("id", "product_id")
    known = testbed.purchases(spark, d, ("product_id",)).distinct()
    spelled = raw.withColumn("product_id", F.regexp_replace("product_id", r"-(\d+)kg\s*$", " $1"))
    matched = catalog.match_known_products(spelled, known)
    return matched.select("id", "matched_name")


@query
def match_similar_products(spark, d):
    """Names as printed, with a letter dropped, and with all words cut to four letters."""
    lines = testbed.purchases(spark, d, ("id", "product_id"), "l_linenumber")
    known = lines.groupBy("product_id").agg(F.count("*").alias("total_purchases"))
    cut = F.regexp_replace(F.upper("product_id"), r"(\p{L}{4})\p{L}*", "$1.")
    printed = (
        F.when(F.col("l_linenumber") == 1, F.regexp_replace("product_id", "^(.)(.)", "$1"))
        .when(F.col("l_linenumber") == 2, cut)
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("x"), F.col("product_id"), F.lit("y")))
        .otherwise(F.concat(F.lit(" "), F.upper("product_id")))
    )
    spelled = lines.withColumn("product_id", printed)
    known = known.withColumn("product_id", text.clean_name("product_id"))
    matched = catalog.match_similar_products(spelled, known)
    return matched.select("id", "product_id", "matched_name", "matched_by")


# --- Edits -------------------------------------------------------------------------


@query
def diff_purchases(spark, d):
    original, edited = testbed.original_lines(spark, d), testbed.edited_lines(spark, d)
    return edits.diff_purchases(original, edited).select("op", "id", "product_id", "product_price")


@query
def edit_counts(spark, d):
    original, edited = testbed.original_lines(spark, d), testbed.edited_lines(spark, d)
    return edits.change_counts(edits.diff_purchases(original, edited))


@query
def deleted_ids(spark, d):
    original, edited = testbed.original_lines(spark, d), testbed.edited_lines(spark, d)
    return edits.diff_purchases(original, edited).where("op = 'deleted'").select("id")


@query
def apply_purchase_edits(spark, d):
    return edits.apply_purchase_edits(
        testbed.original_lines(spark, d), testbed.edited_lines(spark, d)
    )


# --- Files -------------------------------------------------------------------------


@query
def scan_purchases_csv(spark, d):
    """Files of another program: doubled quotes, commas, null words, two layouts."""
    path = fresh_path(spark, "csv")
    lines = testbed.original_lines(spark, d).withColumns(
        {
            "product_id": F.concat(F.col("product_id"), F.lit(' "extra", grande')),
            "nfce_url": F.when(F.col("quantity") == 1, "NULL").otherwise(F.col("nfce_url")),
        }
    )
    for part, columns in (("long", lines.columns), ("short", lines.drop("access_key").columns)):
        chosen = lines.where((F.col("quantity") > 25) == (part == "long"))
        cells = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
                 for c in columns]
        text = chosen.select(F.concat_ws(",", *cells).alias("value"))
        # the header is the first line of every file
        text.mapInArrow(testbed.headed(",".join(columns)), "value string").write.text(f"{path}/{part}")
    return files.scan_purchases_csv(spark, f"{path}/*")


@query
def scan_receipt_json(spark, d):
    lines = testbed.original_lines(spark, d)
    amounts = ("quantity", "unit_price", "product_price")
    items = lines.drop("id").withColumns({c: F.col(c).cast("double") for c in amounts})
    path = fresh_path(spark, "receipts")
    text = items.select(F.to_json(F.array(F.struct(*items.columns))))
    text.write.option("compression", "snappy").text(path)
    return files.scan_receipt_json(spark, path, per_line=True)


@query
def export_due_csv(spark, d):
    path = fresh_path(spark, "due")
    files.export_csv(restock.due_list(_flagged(spark, d)), path)
    return spark.read.option("header", True).csv(path).select(
        "product_id",
        "last_purchase_date",
        F.col("overdue_days").cast("double"),
        F.col("total_purchases").cast("bigint"),
    )


# --- Layer tables ------------------------------------------------------------------


def _layers(spark: SparkSession) -> Layers:
    layers = Layers(spark, fresh_path(spark, "layers"), f"t{uuid.uuid4().hex[:10]}_")
    layers.create()
    return layers


def _with_raw(spark, d) -> Layers:
    layers = _layers(spark)
    imports.ingest_to_raw(layers, _raw(spark, d).drop("id"), "csv")
    return layers


def _with_bronze(spark, d) -> Layers:
    layers = _with_raw(spark, d)
    imports.raw_to_bronze(layers)
    return layers


def _with_silver(spark, d) -> Layers:
    layers = _with_raw(spark, d)
    imports.refresh_layers(layers, as_of=AS_OF)
    return layers


_LINE_OUT = _BRONZE_OUT[1:]


@query
def scan_raw(spark, d):
    return _with_raw(spark, d).scan_raw().drop("id", "ingested_at", "ingest_id")


@query
def ingest_to_raw(spark, d):
    """Numbers of lines and ids per source after two imports, and how far the ids reach."""
    layers = _with_raw(spark, d)
    lines = testbed.purchases(
        spark, d, ("purchase_date", "product_id", "quantity", "unit_price", "market_id")
    )
    imports.ingest_to_raw(layers, lines, "ocr")
    raw = layers.scan_raw()
    return raw.groupBy("source_type").agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        (F.max("id") - F.min("id") + 1).alias("id_span"),
        F.sum(F.col("product_price").try_cast("decimal(10,2)")).alias("spent"),
    )


@query
def scan_bronze(spark, d):
    return _with_bronze(spark, d).scan_bronze().drop("id")


@query
def scan_bronze_editable(spark, d):
    return _with_bronze(spark, d).scan_bronze_editable().drop("id")


@query
def append_bronze(spark, d):
    """A second run over the same raw lines adds none."""
    layers = _with_bronze(spark, d)
    imports.raw_to_bronze(layers)
    return layers.scan_bronze_exact().select(*_LINE_OUT)


@query
def raw_to_bronze_stream(spark, d):
    """Two runs of the stream with new raw lines in between."""
    layers = _with_raw(spark, d)
    name = f"raw-{uuid.uuid4().hex[:10]}"
    streams.raw_to_bronze_stream(layers, name)
    imports.ingest_to_raw(layers, testbed.raw_purchases(spark, d).drop("id"), "ocr")
    streams.raw_to_bronze_stream(layers, name)
    return layers.scan_bronze_exact().select(*_LINE_OUT)


@query
def refresh_layers(spark, d):
    layers = _with_silver(spark, d)
    return layers.scan_silver("silver_product_stats")


@query
def scan_product_stats(spark, d):
    return _with_silver(spark, d).scan_product_stats()


@query
def scan_market_stats(spark, d):
    return _with_silver(spark, d).scan_market_stats()


@query
def scan_monthly_spending(spark, d):
    return _with_silver(spark, d).scan_monthly_spending()


@query
def refresh_silver(spark, d):
    layers = _with_silver(spark, d)
    imports.refresh_silver(layers, AS_OF)
    return layers.scan_silver("silver_market_stats")


@query
def silver_after_changes(spark, d):
    """Silver added up from the pieces of two imports and an edit of the first."""
    layers = _with_silver(spark, d)
    original = edits.editable(layers.scan_bronze_exact())
    kept = original.where(~F.col("product_id").startswith("Old"))
    imports.apply_edits(layers, original, kept, AS_OF)
    imports.import_purchases(layers, _raw(spark, d).drop("id"), "ocr", AS_OF)
    return layers.scan_silver("silver_product_stats")


@query
def apply_edits_to_layers(spark, d):
    """Remove, reprice and add lines of imported Bronze; add the same lines once more; import
    again, and show what is there."""
    layers = _with_bronze(spark, d)
    original = edits.editable(layers.scan_bronze_exact())
    added = original.where("quantity = 50").withColumn("id", F.lit(None).cast("bigint"))
    added = staged(added, "added")
    kept = original.where(~F.col("product_id").startswith("Old"))
    edited = kept.withColumn(
        "product_price",
        F.when(F.col("product_id").startswith("New"), F.col("product_price") + 1)
        .otherwise(F.col("product_price"))
        .cast("decimal(10,2)"),
    )
    imports.apply_edits(layers, original, edited.unionByName(added), AS_OF)
    none = original.where("false")
    imports.apply_edits(layers, none, added, AS_OF)
    imports.raw_to_bronze(layers)
    return layers.scan_bronze_exact().select(*_LINE_OUT)


@query
def evolve_schema(spark, d):
    old = testbed.original_lines(spark, d).drop(*LATER_COLUMNS)
    return evolve_purchases(old, backfill=True)


@query
def evolve_tables(spark, d):
    """A Bronze table of the old form, without the later columns, taken over."""
    layers = Layers(spark, fresh_path(spark, "layers"), f"t{uuid.uuid4().hex[:10]}_")
    spark.sql(f"CREATE SCHEMA {layers.prefix}bronze LOCATION '{layers.root}/bronze'")
    lines = testbed.original_lines(spark, d).drop(*LATER_COLUMNS).withColumns(
        {
            "id": F.monotonically_increasing_id() + 1,
            "raw_id": F.monotonically_increasing_id() + 1,
            "processed_at": F.lit("2026-01-01").cast("timestamp"),
            "reject_reason": F.lit(None).cast("string"),
            "ingest_id": F.lit("old"),
            "rejected": F.lit(False),
        }
    )
    table = layers.name("bronze", "bronze_lines")
    lines.write.partitionBy("ingest_id", "rejected").saveAsTable(table)
    layers.create()
    return layers.scan_bronze_exact().select(*_LINE_OUT)


@query
def migrate_legacy(spark, d):
    layers = _layers(spark)
    legacy = layers.name("raw", "old_purchases")
    testbed.purchases(
        spark, d, ("purchase_date", "product_id", "product_price", "market_id")
    ).write.saveAsTable(legacy)
    imports.migrate_legacy(layers, legacy)
    imports.migrate_legacy(layers, legacy)
    return layers.scan_raw().drop("id", "ingested_at", "ingest_id")


# --- Receipt text ------------------------------------------------------------------


@query
def receipt_rejects(spark, d):
    """Every seventh line's receipt is no JSON array; it is set aside with its text."""
    lines = testbed.original_lines(spark, d)
    good = F.to_json(F.array(F.struct("purchase_date", "product_id")))
    text = F.when(F.col("quantity") % 7 == 0, F.concat(F.lit("unreadable "), "product_id")).otherwise(good)
    path = fresh_path(spark, "receipts")
    lines.select(text.alias("value")).write.text(path)
    found = files.receipt_rejects(spark, path, per_line=True)
    return found.groupBy("text", "reason").agg(F.count("*").alias("n"))


@query
def oversized_amounts(spark, d):
    """Quantities and unit prices that do not fit their columns."""
    lines = testbed.original_lines(spark, d)
    raw = lines.select("id", *[F.col(c).cast("string").alias(c) for c in lines.columns if c != "id"])
    spoiled = raw.withColumns(
        {
            "quantity": F.when(F.col("quantity") == "7.000", "99999999").otherwise(F.col("quantity")),
            "unit_price": F.when(F.col("quantity") == "9.000", "1e12").otherwise(F.col("unit_price")),
        }
    )
    cleaned = cleaning.clean_purchases(spoiled)
    return cleaning.rejected(cleaned).select(F.col("raw_id").cast("string").alias("id"), "reason")


@query
def receipt_items(spark, d):
    """Product lines of printed receipts, taken apart."""
    lines = testbed.receipt_lines(spark, d).where(receipts.is_product_line("line"))
    return lines.select(
        "id",
        receipts.line_quantity("line").alias("quantity"),
        receipts.line_unit_price("line").alias("unit_price"),
        receipts.line_total("line").alias("total"),
        receipts.strip_pack_size("name").alias("name"),
        receipts.parse_br_date("printed_date").alias("purchase_date"),
        receipts.clean_access_key("key").alias("access_key"),
        receipts.valid_receipt_url("url").alias("url_ok"),
    )


@query
def whole_receipts(spark, d):
    """Printed receipts, a receipt an order, to purchase lines."""
    found = whole.whole_receipts(testbed.whole_receipts(spark, d))
    return found.withColumn("receipt_id", F.col("receipt_id").cast("string")).drop("line_no")
