"""Rules for the text of printed Brazilian receipts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.numbers import coerce_number
from tillroll.functions.text import strip

_QUANTITY = r"(?<![0-9.,])([0-9][0-9.]*(?:,[0-9]+)?)"
_PRICE = r"([0-9][0-9.]*,[0-9]{2})(?![0-9,])"
# The last such pair of a line: packs such as 2X500ML come before it and show no price.
_IF_QTY_TIMES_UNIT = rf"(?i)^(?:.*{_QUANTITY}\s*(?:kg|g|un|l|ml)?\s*[x*]\s*(?:R\$\s*)?{_PRICE})?"
_LAST_PRICE = rf"^.*(?<![0-9.,]){_PRICE}"
# Stands between amounts; the same character in a line is replaced, which no pattern minds.
_MARK, _OTHER = "\ue001", "\ue002"

# Words that open a receipt line which is not a product. What follows them is
# more such words, an amount, a colon or the end: a product may begin with one of them.
_NOT_A_PRODUCT = (
    r"(?iU)^\s*(?:(?:sub\s*-?\s*total|total|qtd\.?\s+total|troco|desconto|acr[eé]scimo|"
    r"taxas?|dinheiro|cart[aã]o|pix|cr[eé]dito|d[eé]bito|cpf|cnpj|consumidor|"
    r"tributos?|valor\s+(?:a\s+)?pag(?:ar|o)|forma\s+de\s+pagamento)\b[\s.]*"
    r"(?:(?:de|da|do|em|no|na|itens|aprox)\b[\s.]*)*)+"
    r"(?::|-|R\$|[0-9][0-9.,/-]*\s*$|[0-9.]+,[0-9]{2}|$)"
)

_PACK_SIZE = (
    r"(?i)\s*\b(?:(?:[0-9]+\s*x\s*)?[0-9]+(?:[.,][0-9]+)?\s*(?:kg|g|mg|l|lt|ml|un|und|pct|cx|m|cm)|kg|und?|pct|cx)\b"
)


def parse_br_number(col: Column | str) -> Column:
    """``1.234,56`` or ``R$ 1.234,56`` to 1234.56."""
    bare = F.regexp_replace(strip(col), r"^R\$\s*", "")
    return coerce_number(F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def _br_digits(text: Column) -> Column:
    """``1.234,56`` of digits, points and at most one comma to 1234.56; empty text to null."""
    return F.translate(text, ",.", ".").try_cast("double")


def parse_br_date(col: Column | str) -> Column:
    """Day-first ``24/05/2026`` to a date."""
    text = strip(col)
    iso = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), iso.try_cast("date"))


def _amounts(col: Column | str) -> Column:
    """Quantity, mark, unit price, mark and the rest of the line; both are empty and the rest is
    the line where it shows none.

    All three amounts come from this one search, which Spark makes once for a projection.
    """
    column = F.col(col) if isinstance(col, str) else col
    unmarked = F.replace(column, F.lit(_MARK), F.lit(_OTHER))
    return F.regexp_replace(unmarked, _IF_QTY_TIMES_UNIT, f"$1{_MARK}$2{_MARK}")


def line_quantity(col: Column | str) -> Column:
    """Left side of ``3 x 4,50`` or ``0,750 kg x 12,90``; 1 where the line shows none."""
    return F.coalesce(_br_digits(F.substring_index(_amounts(col), _MARK, 1)), F.lit(1.0))


def line_unit_price(col: Column | str) -> Column:
    """Right side of ``3 x 4,50``; null where the line shows none."""
    return _br_digits(F.substring_index(F.substring_index(_amounts(col), _MARK, 2), _MARK, -1))


def line_total(col: Column | str) -> Column:
    """The amount paid, printed after quantity times unit price or alone; else null.

    It prevails over quantity times unit price, as everywhere.
    """
    rest = F.substring_index(_amounts(col), _MARK, -1)
    return _br_digits(F.regexp_extract(rest, _LAST_PRICE, 1))


def shows_price(col: Column | str) -> Column:
    """Whether the line shows any price; a product line without one is set aside."""
    column = F.col(col) if isinstance(col, str) else col
    return F.coalesce(column.rlike(_LAST_PRICE), F.lit(False))


def clean_access_key(col: Column | str) -> Column:
    """The 44 digits of a receipt key, blocks joined; null for anything else."""
    digits = F.regexp_replace(col, r"\s", "")
    return F.when(digits.rlike(r"^[0-9]{44}$"), digits)


def valid_receipt_url(col: Column | str) -> Column:
    """http(s) address with a ``p`` parameter."""
    column = F.col(col) if isinstance(col, str) else col
    return F.coalesce(column.rlike(r"^https?://[^?#\s]+\?([^#\s]*&)?p=[^&#\s]+"), F.lit(False))


def is_product_line(col: Column | str) -> Column:
    column = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~column.rlike(_NOT_A_PRODUCT), F.lit(False))


def strip_pack_size(col: Column | str) -> Column:
    """Name without weights, volumes and unit words."""
    return strip(F.regexp_replace(col, _PACK_SIZE, ""))
