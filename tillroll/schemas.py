"""Declared schemas of the layer tables and of the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How the files of the layers and what is staged for them are compressed.
CODEC = "zstd"
# How they are written. Columns that hardly repeat get no dictionary, which would be filled for
# every row group, found too large and given up.
_HARDLY_REPEATED = (
    "id", "raw_id", "product_id", "product_price", "unit_price", "access_key", "nfce_url"
)
FILES = {
    "compression": CODEC,
    **{f"parquet.enable.dictionary#{name}": "false" for name in _HARDLY_REPEATED},
}

_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
_DATE, _TIME = T.DateType(), T.TimestampType()
_MONEY, _WEIGHT, _TICKET = T.DecimalType(10, 2), T.DecimalType(10, 3), T.DecimalType(12, 2)
# Totals are wider than the money columns: sums grow with the data.
_TOTAL = T.DecimalType(20, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW = _struct(
    id=_LONG,
    purchase_date=_TEXT,
    product_id=_TEXT,
    product_price=_TEXT,
    quantity=_TEXT,
    unit_price=_TEXT,
    market_id=_TEXT,
    access_key=_TEXT,
    nfce_url=_TEXT,
    ingested_at=_TIME,
    source_type=_TEXT,
)
BRONZE = _struct(
    id=_LONG,
    purchase_date=_DATE,
    product_id=_TEXT,
    product_price=_MONEY,
    quantity=_WEIGHT,
    unit_price=_MONEY,
    market_id=_TEXT,
    access_key=_TEXT,
    nfce_url=_TEXT,
    raw_id=_LONG,
    processed_at=_TIME,
)
BRONZE_LINES = T.StructType([*BRONZE.fields, T.StructField("reject_reason", _TEXT)])
BY_INGEST = _struct(ingest_id=_TEXT)
# Where a line lies: what was written together, its ingest, and whether it was set aside.
PLACED_LINES = T.StructType(
    [*BRONZE_LINES.fields, *_struct(generation=_TEXT, ingest_id=_TEXT, rejected=T.BooleanType())]
)
# Lines of one ingest that were written together; ``whole`` if the ingest is done with them,
# ``source`` if a stream brought them.
PIECES = _struct(
    ingest_id=_TEXT,
    generation=_TEXT,
    source=_TEXT,
    whole=T.BooleanType(),
    lines=_LONG,
    deleted=_LONG,
)
# reject_reason of a line deleted by hand
DELETED_BY_HAND = "deleted"
PRODUCT_STATS = _struct(
    product_id=_TEXT,
    last_purchase_date=_DATE,
    avg_days_purchase=_MONEY,
    avg_product_price=_MONEY,
    min_product_price=_MONEY,
    max_product_price=_MONEY,
    total_purchases=_LONG,
    days_last_purchase=_MONEY,
)
MARKET_STATS = _struct(
    market_id=_TEXT,
    total_spent=_TOTAL,
    avg_ticket=_TICKET,
    visit_count=_LONG,
    last_visit=_DATE,
)
MONTHLY_SPENDING = _struct(
    year_month=_TEXT, total_spent=_TOTAL, item_count=_LONG, avg_price=_MONEY
)
RECEIPT = _struct(
    purchase_date=_TEXT,
    product_id=_TEXT,
    quantity=_DOUBLE,
    unit_price=_DOUBLE,
    product_price=_DOUBLE,
    market_id=_TEXT,
    access_key=_TEXT,
    nfce_url=_TEXT,
)

# Columns that tables made before they existed may lack.
LATER_COLUMNS = ("quantity", "unit_price", "access_key", "nfce_url")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in schema order with schema types, missing ones as null."""
    return df.select(
        [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in LATER_COLUMNS if c not in df.columns]


def evolve_purchases(df: DataFrame, *, backfill: bool) -> DataFrame:
    """Add the later columns as null; backfill amounts only if one was missing."""
    missing = missing_columns(df)
    if not missing:
        return df
    types = {f.name: f.dataType for f in (BRONZE if backfill else RAW)}
    df = df.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in missing])
    if not backfill:
        return df
    return df.withColumns(
        {
            "quantity": F.coalesce("quantity", F.lit(1).cast(types["quantity"])),
            "unit_price": F.coalesce("unit_price", F.col("product_price").cast(types["unit_price"])),
        }
    )
