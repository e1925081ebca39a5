"""Raw text lines to typed purchase lines, with a reason for each line kept out."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.dates import date_of, parse_purchase_date
from tillroll.functions.numbers import coerce_number, number_of, rint_decimal
from tillroll.functions.text import blank_to_null, capitalised, strip
from tillroll.schemas import RECEIPT

MANUAL_RAW_ID = 0
_TOO_LARGE = 99_999_999.995  # rounds to more than a decimal(10,2) holds
_TEXTS = (
    "purchase_date",
    "product_id",
    "product_price",
    "quantity",
    "unit_price",
    "market_id",
    "access_key",
    "nfce_url",
)


def reconcile_amounts(quantity: Column, unit_price: Column, total: Column) -> dict[str, Column]:
    """Fill in missing amounts; the paid total wins and rounding comes last.

    Takes doubles, gives quantity, unit_price and product_price as decimals.
    """
    exact = unrounded_amounts(quantity, unit_price, total)
    return {name: rint_decimal(v, 3 if name == "quantity" else 2) for name, v in exact.items()}


def unrounded_amounts(quantity: Column, unit_price: Column, total: Column) -> dict[str, Column]:
    qty = F.when(quantity > 0, quantity).otherwise(F.lit(1.0))
    return {
        "quantity": qty,
        "unit_price": F.coalesce(unit_price, total / qty),
        "product_price": F.coalesce(total, unit_price * qty),
    }


def clean_purchases(
    raw: DataFrame, *, processed_at: datetime | None = None, strict: bool = False
) -> DataFrame:
    """Typed purchase lines plus ``reject_reason``, null for lines fit for Bronze.

    ``strict`` fails the job on a date that cannot be read instead of setting the
    line aside. The steps are separate projections, so that each text is stripped only
    once.
    """

    def tidy(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast("string").alias(name)
        # What stands for no value is no number either.
        return (strip(name) if name in amount_texts else blank_to_null(name)).alias(name)

    amount_texts = ("quantity", "unit_price", "product_price")
    kept = [c for c in ("ingest_id",) if c in raw.columns]
    texts = raw.select(F.col("id").alias("raw_id"), *[tidy(c) for c in _TEXTS], *kept)
    day = date_of(F.col("purchase_date"))
    if strict:
        unreadable = F.concat(
            F.lit("unreadable purchase_date: "), F.coalesce("purchase_date", F.lit("null"))
        )
        day = F.coalesce(day, F.raise_error(unreadable).cast("date"))
    typed = texts.withColumns(
        {
            "product_id": capitalised("product_id"),
            "market_id": capitalised("market_id"),
            **{c: number_of(F.col(c)) for c in amount_texts},
        }
    )
    amounts = reconcile_amounts(*[F.col(c) for c in amount_texts])
    # An amount too large for its column is a reason of its own, not a missing amount.
    exact = unrounded_amounts(*[F.col(c) for c in amount_texts])
    sizes = [F.abs(exact["quantity"]) * 10, F.abs(exact["unit_price"])]
    unfit = F.greatest(*sizes) >= _TOO_LARGE
    stamp = F.lit(processed_at or datetime.now(tz=UTC)).cast("timestamp")
    line = F.struct(
        F.col("raw_id").alias("id"),
        "purchase_date",
        "product_id",
        "product_price",
        "quantity",
        "unit_price",
        "market_id",
        "access_key",
        "nfce_url",
        "raw_id",
        stamp.alias("processed_at"),
        F.when(F.col("purchase_date").isNull(), "date")
        .when(F.col("product_id").isNull(), "product")
        .when(F.col("market_id").isNull(), "market")
        .when(F.col("product_price").isNull(), "price")
        .when(F.col("unfit_amount"), "amount")
        .alias("reject_reason"),
        *kept,
    )
    # A filter on the result would be pushed down to the raw lines, past the projections, and
    # parse every text there once more for each use of it. Nothing passes a generated row.
    amended = typed.withColumns({"purchase_date": day, "unfit_amount": unfit, **amounts})
    return amended.select(F.inline(F.array(line)))


def accepted(cleaned: DataFrame) -> DataFrame:
    """Lines fit for Bronze."""
    return cleaned.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("reject_reason").isNotNull()).select(
        "raw_id", F.col("reject_reason").alias("reason"), "processed_at"
    )


def processed_ids(*tables: DataFrame) -> DataFrame:
    """raw_id of every line already taken in, set aside or deleted by hand.

    Lines added by hand all carry raw_id 0; they stay out so that they do not
    pile up in one join partition. No distinct: the anti join needs none.
    """
    keyed = ["ingest_id"] if all("ingest_id" in t.columns for t in tables) else []
    ids = [t.where(F.col("raw_id") != MANUAL_RAW_ID).select("raw_id", *keyed) for t in tables]
    union = ids[0]
    for more in ids[1:]:
        union = union.unionByName(more)
    return union


def distinct_processed_ids(*tables: DataFrame) -> DataFrame:
    return processed_ids(*tables).select("raw_id").distinct()


def unprocessed_raw(raw: DataFrame, *taken: DataFrame) -> DataFrame:
    """Raw lines whose id is in none of the taken tables (each with ``raw_id``).

    Where all sides name the ingest, ids are compared within it.
    """
    ids = processed_ids(*taken)
    on = raw["id"] == ids["raw_id"]
    if "ingest_id" in raw.columns and "ingest_id" in ids.columns:
        on = on & (raw["ingest_id"] == ids["ingest_id"])
    return raw.join(ids, on, "left_anti")


def derive_total(df: DataFrame) -> DataFrame:
    """Add product_price = quantity x unit_price where the column itself is absent."""
    if "product_price" in df.columns or not {"quantity", "unit_price"} <= set(df.columns):
        return df
    factors = [coerce_number(F.col(c).cast("string")) for c in ("quantity", "unit_price")]
    return df.withColumn("product_price", factors[0] * factors[1])


def stringify_purchases(df: DataFrame, source_type: str) -> DataFrame:
    """Lines of any source as the text columns of the raw table, still without id."""
    df = derive_total(df)

    def text(name: str, default: Column) -> Column:
        value = F.col(name).cast("string") if name in df.columns else default
        return value.alias(name)

    empty = F.lit("")
    return df.select(
        text("purchase_date", F.lit(None).cast("string")),
        text("product_id", F.lit(None).cast("string")),
        text("product_price", F.lit(None).cast("string")),
        text("quantity", empty),
        text("unit_price", empty),
        text("market_id", F.lit(None).cast("string")),
        *[
            F.coalesce(F.col(c).cast("string") if c in df.columns else empty, empty).alias(c)
            for c in ("access_key", "nfce_url")
        ],
        F.lit(datetime.now(tz=UTC)).cast("timestamp").alias("ingested_at"),
        F.lit(source_type).alias("source_type"),
    )


def conform_receipt(df: DataFrame) -> DataFrame:
    """The eight receipt columns typed and in order, extra columns kept at the end.

    Unreadable dates and numbers become null for a person to fill in.
    """

    def typed(field: T.StructField) -> Column:
        if field.name not in df.columns:
            dtype = "date" if field.name == "purchase_date" else field.dataType
            return F.lit(None).cast(dtype).alias(field.name)
        value = F.col(field.name)
        if field.name == "purchase_date":
            value = parse_purchase_date(value.cast("string"))
        elif isinstance(field.dataType, T.DoubleType):
            value = coerce_number(value.cast("string"))
        return value.alias(field.name)

    extra = [c for c in df.columns if c not in RECEIPT.fieldNames()]
    return df.select(*[typed(f) for f in RECEIPT], *extra)


def is_blank_purchase(alias: str | None = None) -> Column:
    """True for an edited line without date, price, product or market."""

    def of(name: str) -> Column:
        return F.col(f"{alias}.{name}" if alias else name)

    def empty(name: str) -> Column:
        return F.coalesce(strip(of(name)), F.lit("")) == ""

    has_price = of("product_price").isNotNull() | (
        of("quantity").isNotNull() & of("unit_price").isNotNull()
    )
    return of("purchase_date").isNull() | ~has_price | empty("product_id") | empty("market_id")
