"""Number parsing, the two rounding rules and small ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.text import strip

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"


def coerce_number(col: Column | str) -> Column:
    return number_of(strip(col))


def number_of(text: Column) -> Column:
    """Stripped text to double, anything that is not a plain number to null.

    The pattern keeps out what a bare cast to double takes: ``5d``, ``5f``, ``nan``, ``inf``;
    an exponent has three digits at most, which covers every double.
    """
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def rint_decimal(col: Column, places: int, precision: int = 10) -> Column:
    """Bronze rounding: nearest double step with ties to even, then a decimal.

    Values that do not fit the decimal become null rather than failing the job.
    """
    scale = float(10**places)
    return (F.rint(col * scale) / scale).try_cast(f"decimal({precision},{places})")


def exact_ratio(total: Column, count: Column, places: int = 2) -> Column:
    """Silver rounding: decimal quotient, half away from zero; null when count is 0."""
    n = F.nullif(count, F.lit(0)).cast("decimal(18,0)")
    quotient = total.cast("decimal(20,2)") / n
    return F.round(quotient, places).cast(f"decimal(12,{places})")


def pct_change(current: Column, previous: Column) -> Column:
    """(current - previous) / previous; null without a non-zero base."""
    base = F.nullif(previous.cast("double"), F.lit(0.0))
    return (current.cast("double") - base) / base


def spending_tone(change: Column, tolerance: float = 0.02) -> Column:
    return (
        F.when(change.isNull() | (F.abs(change) < tolerance), "neutral")
        .when(change > 0, "bad")
        .otherwise("good")
    )
