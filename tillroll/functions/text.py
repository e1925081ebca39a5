"""Text rules for product, market and receipt columns."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character Python's str.strip() removes; F.trim alone removes only spaces.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Texts that stand for "no value" in raw columns.
MISSING_TOKENS = ("", "nan", "None", "<NA>", "NaT")

# Collation under which two spellings name the same product or market:
# case, accents and trailing spaces do not count.
NAME_COLLATION = "UNICODE_CI_AI_RTRIM"

# Markets with a bucket of their own, and the number of shared buckets.
KNOWN_MARKETS = ("swift", "atacadao")
MARKET_BUCKETS = 5

# No text that begins with a visible ASCII character sorts after it.
_LAST_VISIBLE = "\x7f"
_BREAK = "\ue000 "
_UNCASED = r"([^\p{IsUppercase}\p{IsLowercase}\p{Lt}])"
# Words of ASCII letters, with other characters only after their letters: initcap is right there.
_PLAIN_WORDS = r"^(?:[A-Za-z]*+[!-@\[-`{-~]*+(?: |$))*+$"


def strip(col: Column | str) -> Column:
    """Without whitespace at both ends. A named column is looked at first: a text that begins
    and ends with a visible ASCII character is not searched for the whole set."""
    if not isinstance(col, str):
        return F.trim(col, F.lit(WHITESPACE))
    text = F.col(col).cast("string")
    last = F.substring(text, -1, 1)
    visible = text.between("!", _LAST_VISIBLE) & last.between("!", "~")
    return F.when(visible, text).otherwise(F.trim(text, F.lit(WHITESPACE)))


def blank_to_null(col: Column | str) -> Column:
    """Stripped text, or null where it holds one of the missing tokens."""
    text = strip(col)
    return F.when(~text.isin(*MISSING_TOKENS), text)


def clean_name(col: Column | str) -> Column:
    return capitalised(strip(col))


def capitalised(text: Column | str) -> Column:
    """Capitalise every letter that follows a non-letter, the others small.

    ``initcap`` starts a word only after a space, so ``coca-cola 2l`` would become
    ``Coca-cola 2l``. A private marker plus a space goes in after each uncased
    character and comes out again. Names whose words need no marks go without them.
    """
    column = F.col(text) if isinstance(text, str) else text

    # In a lambda the rest stays out of the generated method, which is compiled only while small.
    other = F.get(F.transform(F.array(column), _by_marks), F.lit(0))
    return F.when(column.rlike(_PLAIN_WORDS), F.initcap(column)).otherwise(other)


def _by_marks(text: Column) -> Column:
    def marked(uncased: str) -> Column:
        broken = F.regexp_replace(text, uncased, f"$1{_BREAK}")
        return F.replace(F.initcap(broken), F.lit(_BREAK), F.lit(""))

    in_ascii = marked(r"([!-@\[-`{-~])(?=[A-Za-z])")
    return F.when(text.rlike("^[ -~]*$"), in_ascii).otherwise(marked(_UNCASED))


@F.pandas_udf(T.StringType())
def _ascii_fold(names: pd.Series) -> pd.Series:
    def fold(name):
        if name is None:
            return None
        return unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()

    return names.map(fold)


def market_key(col: Column | str) -> Column:
    """Accent-free, stripped, lower-case market name (NFKD has no Spark built-in).

    Meant for market-level frames, where rows are markets and not purchase lines.
    """
    column = F.col(col) if isinstance(col, str) else col
    return F.lower(strip(_ascii_fold(column)))


def market_bucket(name: Column | str) -> Column:
    """Stable bucket of a market: a label of its own, or crc32 of its key mod 5."""
    column = F.col(name) if isinstance(name, str) else name
    key = market_key(column)
    shared = (F.crc32(F.encode(key, "UTF-8")) % MARKET_BUCKETS).cast("string")
    return (
        F.when(column == "Total", F.lit("total"))
        .when(key.isin(*KNOWN_MARKETS), key)
        .otherwise(shared)
    )


def receipt_meta(col: Column | str) -> Column:
    """Access key or receipt URL: stripped, missing tokens to null, case kept."""
    return blank_to_null(col)
