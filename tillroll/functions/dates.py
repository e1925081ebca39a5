"""Purchase dates written in several formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.text import blank_to_null

_CLOCK = (
    r"(?:[T ]+\d{1,2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?\s*(?:[AaPp][Mm])?\s*"
    r"(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
_SEP = r"[-/. ]"
# Numeric forms, one rewrite after the other; # marks what was written year last.
_NUMERIC = (
    (rf"^(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}}){_CLOCK}", "#$3-$1-$2"),
    # Two-digit years 69 to 99 are of the last century, the others of this one.
    (r"^#(69|[7-9]\d)-", "#19$1-"),
    (r"^#(\d\d)-", "#20$1-"),
    # Only a first number that can not be a month is a day.
    (r"^#(\d+)-(1[3-9]|2\d|3[01])-(\d{1,2})$", "$1-$3-$2"),
    (
        rf"^#?(\d{{4}})(?:{_SEP}(\d{{1,2}})(?:{_SEP}(\d{{1,2}}))?|(\d{{2}})(\d{{2}}))?{_CLOCK}",
        "$1-$2$4-$3$5",
    ),
)
_MONTH = (
    r"(Jan(?=uary|\b)|Feb(?=ruary|\b)|Mar(?=ch|\b)|Apr(?=il|\b)|May(?=\b)|Jun(?=e|\b)|"
    r"Jul(?=y|\b)|Aug(?=ust|\b)|Sep(?=t\b|tember|\b)|Oct(?=ober|\b)|Nov(?=ember|\b)|"
    r"Dec(?=ember|\b))(?:uary|ruary|ch|il|e|y|ust|tember|t|ober|ember)?\b\.?"
)
_WEEKDAY, _ORDINAL = r"(?i)^(?:[a-z]+,\s*)?", r"(?:st|nd|rd|th)?"
# Named forms as year, month, day; a year of two digits needs a comma or hyphen before it.
_NAMED = (
    (
        rf"{_WEEKDAY}{_MONTH}\s+(?:(\d{{1,2}}){_ORDINAL},?\s+)?"
        rf"(\d{{4}}|(?<=,\s{{1,3}})\d{{2}}){_CLOCK}",
        "#$3 $1 $2",
    ),
    (
        rf"{_WEEKDAY}(\d{{1,2}}){_ORDINAL}[\s-]*{_MONTH},?[\s-]*"
        rf"(\d{{4}}|(?<=[\s-])\d{{2}}){_CLOCK}",
        "#$3 $2 $1",
    ),
    (r"^#(69|[7-9]\d) ", "#19$1 "),
    (r"^#(\d\d) ", "#20$1 "),
)

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_SHORT = r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2}, [1-9]\d{3}$"


def parse_purchase_date(col: Column | str) -> Column:
    return date_of(blank_to_null(col))


def date_of(text: Column) -> Column:
    """Stripped text to date. Ambiguous day and month are read month first.

    A time of day, with or without offset, is dropped: the written date counts. A
    missing day or month is the first. Unreadable text gives null.
    """

    # The commonest forms are taken apart by position; the rewrites below give them the same date.
    iso = F.substring(text, 1, 10).try_cast("date")
    year, first, second = F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2)
    day_first = first.between("13", "31")
    slashed = F.concat_ws(
        "-", year, F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)
    )
    joined = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    month = F.ceil(F.instr(F.lit(_MONTHS), F.substring(text, 1, 3)) / 3)
    day = F.substring_index(F.substring(text, 5, 3), ",", 1)
    short = F.concat_ws("-", F.right(text, F.lit(4)), month.cast("string"), day)
    plain = (
        F.when(text.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}{_CLOCK}"), iso)
        .when(text.rlike(rf"^\d{{2}}{_SEP}\d{{2}}{_SEP}\d{{4}}$"), slashed.try_cast("date"))
        .when(text.rlike(r"^\d{8}$"), joined.try_cast("date"))
        .when(text.rlike(_SHORT), short.try_cast("date"))
    )
    # In a lambda the rewrites stay out of the generated method, which is compiled only while small.
    return F.coalesce(plain, F.get(F.transform(F.array(text), _any_form), F.lit(0)))


def _any_form(text: Column) -> Column:
    def rewritten(forms: tuple, result: str) -> Column:
        column = text
        for pattern, order in forms:
            column = F.regexp_replace(column, pattern, order)
        return F.regexp_extract(column, result, 1)

    numeric = rewritten(_NUMERIC, r"^(\d{4}(?:-\d{1,2}){0,2})-*$").try_cast("date")
    named = F.initcap(rewritten(_NAMED, r"^#(\d{4} [A-Za-z]{3}(?: \d{1,2})?) *$"))
    return F.coalesce(numeric, F.to_date(F.try_to_timestamp(named, F.lit("yyyy MMM[ d]"))))
