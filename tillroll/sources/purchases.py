"""Purchase lines from CSV files and from receipt JSON."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.cleaning import conform_receipt
from tillroll.schemas import RECEIPT

_REQUIRED = {"purchase_date", "product_id", "market_id"}
_AMOUNT_PAIR = {"quantity", "unit_price"}

# Texts that pandas' CSV reader takes for missing by default.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def check_purchase_columns(names: list[str]) -> None:
    missing = _REQUIRED - set(names)
    if missing:
        raise ValueError(f"purchase file lacks columns: {sorted(missing)}")
    if "product_price" not in names and not _AMOUNT_PAIR <= set(names):
        raise ValueError("purchase file needs product_price, or quantity and unit_price")


def scan_purchases_csv(
    spark: SparkSession, path: str, *, multi_line: bool = False, **options
) -> DataFrame:
    """CSV with headers, every column as text, quoted as other programs quote it.

    A quote inside a quoted value is doubled. ``multi_line`` allows line breaks inside quotes;
    such files cannot be split between tasks. Without inference a 44-digit access key stays
    text. Files of one path may have different columns: files are read by header, and columns
    that some lack are null there. Texts that pandas reads as missing are null.
    """
    names_of = _headers(spark, path)
    quoting = {"quote": '"', "escape": '"', "multiLine": multi_line, "header": True}
    frames = []
    for header, files in sorted(names_of.items()):
        reader = spark.read.options(enforceSchema=False, **(quoting | options))
        names = reader.csv(files).columns
        check_purchase_columns(names)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        frames.append(reader.schema(schema).csv(files))
    if not frames:
        raise ValueError(f"no purchase file at {path}")
    lines = frames[0]
    for more in frames[1:]:
        lines = lines.unionByName(more, allowMissingColumns=True)
    return lines.select(
        *[F.when(~F.col(f"`{c}`").isin(*NULL_WORDS), F.col(f"`{c}`")).alias(c) for c in lines.columns]
    )


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each header line. Only the first block of a file is looked at, and one row
    for each file comes to the driver, as Spark's own file listing does."""

    def first_lines(batches):
        """The first line of every file block, in the order that a task reads them."""
        seen = set()
        for batch in batches:
            paths = batch["file_path"].to_pylist()
            new = [k for k, p in enumerate(paths) if p not in seen and paths.index(p) == k]
            seen.update(paths[k] for k in new)
            if new:
                yield batch.select(["file_path", "value"]).take(pa.array(new, pa.int64()))

    lines = spark.read.text(path).select(
        "value", "_metadata.file_path", "_metadata.file_block_start"
    )
    heads = lines.where("file_block_start = 0").mapInArrow(first_lines, "file_path string, value string")
    found: dict[str, list[str]] = {}
    for row in heads.groupBy("file_path").agg(F.first("value").alias("value")).collect():
        found.setdefault(row["value"], []).append(unquote(row["file_path"]))
    return found


def scan_receipt_json(
    spark: SparkSession, path: str, *, per_line: bool = False, strict: bool = False
) -> DataFrame:
    """Receipt extractions, each a JSON array of items, as conformed purchase lines.

    One array per file, or with ``per_line`` one per line of a large log of them. An empty
    array gives no lines. Text that is no such array is in ``receipt_rejects``; with
    ``strict`` it fails the job.
    """
    read = _receipts(spark, path, per_line)
    items = F.col("items")
    if strict:
        unreadable = F.concat(F.lit("unreadable receipt in "), "path")
        items = F.coalesce(items, F.raise_error(unreadable).cast(_ITEMS))
    return conform_receipt(read.select(F.inline(items)))


def receipt_rejects(spark: SparkSession, path: str, *, per_line: bool = False) -> DataFrame:
    """(path, text, reason) of receipt texts that ``scan_receipt_json`` can take no lines from."""
    read = _receipts(spark, path, per_line)
    return read.where("items IS NULL").select("path", "text", F.lit("receipt").alias("reason"))


# Amounts are read as text too, so that quoted numbers count as numbers.
_ITEMS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in RECEIPT.fieldNames()]))


def _receipts(spark: SparkSession, path: str, per_line: bool) -> DataFrame:
    texts = spark.read.text(path, wholetext=not per_line)
    is_array = F.col("value").rlike(r"(?s)^\s*\[.*\]\s*$")
    return texts.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text"),
        F.when(is_array, F.from_json("value", _ITEMS)).alias("items"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside a quoted value are doubled."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
