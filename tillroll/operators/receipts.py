"""Whole receipts: the printed lines of each to purchase lines with the receipt's own data.

What a line is depends on what the receipt has said before: the first line names the market,
items come before the total, amounts after it are payments. Aggregates over each receipt find
these places, date, key and address by line number, and items are judged against them. A
receipt of any length is read in order, not collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.functions import receipts as text
from tillroll.functions.numbers import rint_decimal
from tillroll.functions.text import clean_name, strip

_DATE = r"(?<!\d)(\d{1,2}/\d{1,2}/\d{4})(?!\d)"
_KEY = r"(?<!\d)((?:\d{4}\s*){11})(?!\d)"
_URL = r"(https?://\S+)"
# Words that open the line of the amount due, and lines of a market's own data.
_DUE = r"(?iU)^\s*(?:valor\s+)?total\b(?!\s+(?:de\s+)?(?:itens|tributos))"
_NOT_A_MARKET = r"(?iU)^\s*(?:cnpj|cpf|ie|im|emiss[aã]o|danfe|nfc-?e|cupom|extrato|rua|av)\b"
# Number of the item and its code, before the name.
_CODES = r"^\s*(?:\d{1,3}\s+)?(?:\d{6,14}\s+)?(?=\p{L})"
_AMOUNTS = (
    r"(?i)\s*(?<![0-9.,])[0-9][0-9.]*(?:,[0-9]+)?\s*(?:kg|g|un|l|ml)?\s*[x*]\s*(?:R\$\s*)?"
    r"[0-9][0-9.]*,[0-9]{2}.*$"
)
_LAST_AMOUNT = r"\s*(?:R\$\s*)?(?<![0-9.,])[0-9][0-9.]*,[0-9]{2}\s*\D{0,3}$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A function of a value that is made once, and outside of the generated method, which is
    compiled only while small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of_found(pattern: str, use: Callable[[Column], Column]) -> Column:
    """A function of what a pattern finds in the line; null where it finds nothing."""
    return _let(
        F.col("line"),
        lambda line: _let(F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), use),
    )


def _shown() -> dict[str, Column]:
    """What each line shows of the receipt's own data. What a line needs for it is looked for
    first, so that most lines are not searched."""
    return {
        "day": F.when(F.contains("line", F.lit("/")), _of_found(_DATE, text.parse_br_date)),
        "key": F.when(F.length("line") >= 44, _of_found(_KEY, text.clean_access_key)),
        "url": F.when(
            F.contains("line", F.lit("://")),
            _of_found(_URL, lambda url: F.when(text.valid_receipt_url(url), url)),
        ),
        "due": F.when(F.col("line").rlike(_DUE), _let(F.col("line"), text.line_total)),
    }


def _with_shown(lines: DataFrame) -> DataFrame:
    names = F.col("line").rlike(r"\p{L}") & ~F.col("line").rlike(_NOT_A_MARKET) & F.col("day").isNull()
    return lines.withColumns(_shown()).withColumn("names", names)


def _facts() -> dict[str, Column]:
    """Aggregates over a receipt's lines with what they show."""
    at = F.col("line_no")

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), at))

    return {
        "market_line_text": first(F.when(F.col("names"), F.col("line"))),
        "market_line": F.min(F.when(F.col("names"), at)),
        "purchase_date": first(F.col("day")),
        "access_key": first(F.col("key")),
        "nfce_url": first(F.col("url")),
        "receipt_total": first(F.col("due")),
        "due_line": F.min(F.when(F.col("due").isNotNull(), at)),
    }


def receipt_facts(lines: DataFrame) -> DataFrame:
    """One row for each receipt_id of (receipt_id, line_no, line): market, date, key, address and
    amount due, each from the first line that shows it, and the lines items lie between."""
    found = _with_shown(lines).groupBy("receipt_id").agg(*[v.alias(k) for k, v in _facts().items()])
    return found.select(
        "receipt_id",
        clean_name("market_line_text").alias("market_id"),
        *[k for k in _facts() if k != "market_line_text"],
    )


def whole_receipts(lines: DataFrame) -> DataFrame:
    """Purchase lines of all receipts, each with line_no, the receipt's market, date, key and
    address, its amount due, the sum of its items, and whether these agree to the cent.

    An item is a product line with a price after the market's and before the amount due; where
    its name is not on it, the line before has it. The amount paid prevails over quantity times
    unit price. Receipts without an item give no rows; what a receipt does not show is null, as
    is ``adds_up`` without an amount due. Lines without text count as empty ones.

    The lines of a receipt meet in one task, in order and spilling to disk if they are many; each
    is searched once, and only items are taken apart.
    """
    lines = lines.select("receipt_id", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    price = F.contains("line", F.lit(",")) & text.shows_price("line")
    judged = _with_shown(lines.where("receipt_id IS NOT NULL")).withColumn(
        "kind", F.when(text.is_product_line("line"), F.when(price, "priced").otherwise("above"))
    )
    receipt = W.partitionBy("receipt_id")
    # All lines without a price that bear the number before: none, one, or more if numbers repeat.
    before = receipt.orderBy("line_no").rangeBetween(-1, -1)
    above = F.collect_list(F.when(F.col("kind") == "above", F.col("line"))).over(before)
    priced = (
        judged.withColumns({"above": above, **{k: v.over(receipt) for k, v in _facts().items()}})
        .where("kind = 'priced' AND line_no > market_line")
        .where("due_line IS NULL OR line_no < due_line")
    )
    own = strip(F.regexp_replace(F.regexp_replace("line", _AMOUNTS, ""), _LAST_AMOUNT, ""))
    nameless = ~F.col("name").rlike(r"\p{L}{2}")
    named = priced.select("*", F.explode_outer("above").alias("line_above")).withColumn(
        "name", F.regexp_replace(own, _CODES, "")
    )
    unit, total = text.line_unit_price("line"), text.line_total("line")
    quantity = text.line_quantity("line")
    items = (
        named.withColumn(
            "name",
            F.when(nameless, F.regexp_replace(strip("line_above"), _CODES, "")).otherwise(F.col("name")),
        )
        .where("name IS NOT NULL")
        .select(
            "receipt_id",
            "line_no",
            "purchase_date",
            clean_name(text.strip_pack_size("name")).alias("product_id"),
            rint_decimal(quantity, 3).alias("quantity"),
            rint_decimal(F.coalesce(unit, total / quantity), 2).alias("unit_price"),
            rint_decimal(F.coalesce(total, unit * quantity), 2).alias("product_price"),
            clean_name("market_line_text").alias("market_id"),
            "access_key",
            "nfce_url",
            F.col("receipt_total").cast("decimal(20,2)").alias("receipt_total"),
        )
    )
    total_of_items = F.sum("product_price").over(receipt).cast("decimal(20,2)")
    return items.withColumn("items_total", total_of_items).withColumn(
        "adds_up", F.col("items_total") == F.col("receipt_total")
    )
