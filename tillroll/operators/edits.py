"""Set-based correction of Bronze lines: original set against edited set."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import clean_name, strip
from tillroll.operators.cleaning import MANUAL_RAW_ID, is_blank_purchase, reconcile_amounts

EDITABLE = (
    "purchase_date",
    "product_id",
    "quantity",
    "unit_price",
    "product_price",
    "market_id",
    "access_key",
    "nfce_url",
)
_AMOUNTS = {
    "quantity": "decimal(20,6)",
    "unit_price": "decimal(20,6)",
    "product_price": "decimal(20,6)",
}


def editable(purchases: DataFrame) -> DataFrame:
    return purchases.select("id", *EDITABLE)


def _comparable(name: str, alias: str) -> Column:
    value = F.col(f"{alias}.{name}")
    if name in _AMOUNTS:
        return value.cast(_AMOUNTS[name])
    if name in ("access_key", "nfce_url"):
        return F.nullif(strip(value), F.lit(""))
    return value


def _joined(original: DataFrame, edited: DataFrame) -> DataFrame:
    """One full outer join of both sets, original as ``o`` and edited as ``e``, with ``op``.

    A null id marks a new line. Those match nothing; a second key keeps them from all landing in
    one partition. A known line that was blanked counts as unchanged, a new blank line is left
    out, and an id that is not in the original is ``unknown``.
    """
    spread = F.pmod(F.xxhash64(*EDITABLE), F.lit(1 << 20)).cast("int")
    before = original.withColumn("_spread", F.lit(0)).alias("o")
    after = edited.withColumn(
        "_spread", F.when(F.col("id").isNull(), spread).otherwise(F.lit(0))
    ).alias("e")
    on = (F.col("o.id") == F.col("e.id")) & (F.col("o._spread") == F.col("e._spread"))
    same = F.lit(True)
    for name in EDITABLE:
        same = same & _comparable(name, "o").eqNullSafe(_comparable(name, "e"))
    blank = is_blank_purchase("e")
    op = (
        F.when(F.col("o.id").isNull() & F.col("e.id").isNull(), F.when(~blank, "inserted"))
        .when(F.col("e.id").isNull(), "deleted")
        .when(F.col("o.id").isNull(), "unknown")
        .when(same | blank, "unchanged")
        .otherwise("updated")
    )
    return before.join(after, on, "full_outer").withColumn("op", op).where("op IS NOT NULL")


def diff_purchases(original: DataFrame, edited: DataFrame) -> DataFrame:
    """(op, id, edited columns): inserted, updated, deleted, unchanged or unknown."""
    return _joined(original, edited).select(
        "op", F.coalesce("o.id", "e.id").alias("id"), *[F.col(f"e.{c}").alias(c) for c in EDITABLE]
    )


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("op").agg(F.count("*").alias("n"))


def _cleaned(prefix: str = "") -> dict[str, Column]:
    """Names, amounts and receipt data of edited lines as Bronze holds them."""
    amounts = ("quantity", "unit_price", "product_price")
    text = {c: F.nullif(strip(F.col(prefix + c)), F.lit("")) for c in ("access_key", "nfce_url")}
    return {
        **reconcile_amounts(*[F.col(prefix + c).cast("double") for c in amounts]),
        "product_id": clean_name(F.col(prefix + "product_id")),
        "market_id": clean_name(F.col(prefix + "market_id")),
        **text,
    }


def cleaned_changes(diff: DataFrame, stamp: datetime | None = None) -> DataFrame:
    """Inserted, updated and deleted lines with names, amounts and receipt data cleaned."""
    return diff.where(F.col("op").isin("inserted", "updated", "deleted")).withColumns(
        {**_cleaned(), "processed_at": F.lit(stamp or datetime.now(tz=UTC)).cast("timestamp")}
    )


def merge_changes(bronze: DataFrame, changes: DataFrame) -> DataFrame:
    """Bronze lines with updates in place and deletions left out; no insertions."""
    ids = changes.where(F.col("op") != "inserted").select(
        F.col("id").alias("change_id"),
        "op",
        *[F.col(c).alias(f"new_{c}") for c in (*EDITABLE, "processed_at")],
    )
    joined = bronze.join(ids, bronze["id"] == ids["change_id"], "left")
    updated = F.coalesce(F.col("op") == "updated", F.lit(False))
    kept = joined.where(F.col("op").isNull() | (F.col("op") != "deleted"))
    replaced = {
        c: F.when(updated, F.col(f"new_{c}")).otherwise(F.col(c))
        for c in (*EDITABLE, "processed_at")
    }
    return kept.withColumns(replaced).select(*bronze.columns)


def inserted_lines(changes: DataFrame, below: int = 0) -> DataFrame:
    """New lines with ids under ``below``, so they never meet an imported line's id."""
    return changes.where(F.col("op") == "inserted").select(
        (F.lit(below - 1) - F.monotonically_increasing_id()).alias("id"),
        *EDITABLE,
        F.lit(MANUAL_RAW_ID).cast("bigint").alias("raw_id"),
        "processed_at",
    )


def apply_purchase_edits(original: DataFrame, edited: DataFrame) -> DataFrame:
    """The whole corrected set as one frame (id null for new lines), from one join."""
    joined = _joined(original, edited).where("op NOT IN ('deleted', 'unknown')")
    changed = F.col("op").isin("inserted", "updated")
    new = {c: F.col(f"e.{c}") for c in EDITABLE} | _cleaned("e.")
    return joined.select(
        F.col("o.id").alias("id"),
        *[
            F.when(changed, new[c]).otherwise(F.col(f"o.{c}")).cast(original.schema[c].dataType).alias(c)
            for c in EDITABLE
        ],
    )
