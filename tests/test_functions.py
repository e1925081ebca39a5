import random
import unicodedata
import zlib
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillroll.functions import dates, numbers, receipts, text


def values(spark, items, expression):
    df = spark.createDataFrame(list(enumerate(items)), "i int, s string")
    return [v for _, v in sorted(rows(df.select("i", expression)))]


def test_strip_removes_what_python_strips(spark):
    items = [f"{c}x y{c}" for c in text.WHITESPACE] + ["  ", "", None, "\x1f　a\xa0"]
    got = values(spark, items, text.strip("s"))
    assert got == [None if s is None else s.strip() for s in items]


def test_clean_name_is_strip_and_title(spark):
    rng = random.Random(7)
    letters = "abcXYZ áÉçßñÇ''-_.0123 /()日本ªºŉǆfiİıĀ \t😀éÀõ"
    items = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(3000)]
    items += ["coca-cola 2l", "d'água", "3kg", " ARROZ  ", "pão de queijo", "O'NEIL'S X-TUDO"]
    assert values(spark, items, text.clean_name("s")) == [s.strip().title() for s in items]


def test_missing_tokens(spark):
    items = ["", "  ", "nan", " None ", "<NA>", "NaT", None, "Nan", "x"]
    assert values(spark, items, text.blank_to_null("s")) == [None] * 7 + ["Nan", "x"]


def test_dates(spark):
    expected = {
        "2026-04-18": date(2026, 4, 18),
        " 2026-1-5 ": date(2026, 1, 5),
        "2026/04/18": date(2026, 4, 18),
        "2026-04-18 10:30:00": date(2026, 4, 18),
        "2026-04-18T23:30:00.123Z": date(2026, 4, 18),
        "2026-04-18T23:30:00-03:00": date(2026, 4, 18),
        "01/02/2026": date(2026, 1, 2),
        "13/02/2026": date(2026, 2, 13),
        "24.05.2026": date(2026, 5, 24),
        "20260418": date(2026, 4, 18),
        "Jan 5, 2026": date(2026, 1, 5),
        "January 5, 2026": date(2026, 1, 5),
        "5 Jan 2026": date(2026, 1, 5),
        "Jan 5 2026": date(2026, 1, 5),
        "5-Jan-2026": date(2026, 1, 5),
        "Sat, 18 Apr 2026": date(2026, 4, 18),
        "SEPT 5, 2026": date(2026, 9, 5),
        "01/02/2026 10:30:00 PM": date(2026, 1, 2),
        "2026 04 18": date(2026, 4, 18),
        "01/02/26": date(2026, 1, 2),
        "13/02/26": date(2026, 2, 13),
        "2026-01": date(2026, 1, 1),
        "Mar 2026": date(2026, 3, 1),
        "2026": date(2026, 1, 1),
        "13/13/2026": None,
        "2026-13-01": None,
        "5 Foo 2026": None,
        "2026-02-30": None,
        "2026-04-18 garbage": None,
        "bad": None,
        "": None,
    }
    assert values(spark, list(expected), dates.parse_purchase_date("s")) == list(expected.values())


def test_numbers(spark):
    expected = {
        "17.00": 17.0, " 3 ": 3.0, "-2": -2.0, "+.5": 0.5, "1e3": 1000.0, "5.": 5.0,
        "5d": None, "5f": None, "NaN": None, "inf": None, "1,5": None, "1_000": None,
        "abc": None, "": None, "0x10": None,
    }
    assert values(spark, list(expected), numbers.coerce_number("s")) == list(expected.values())


def test_both_roundings(spark):
    df = spark.sql("SELECT 64.01D / 2 AS d, 2.675D AS t, 1e12D AS big")
    row = df.select(
        numbers.rint_decimal(F.col("d"), 2), numbers.rint_decimal(F.col("t"), 2),
        numbers.rint_decimal(F.col("big"), 2),
    ).first()
    assert [str(v) for v in row] == ["32.01", "2.68", "None"]
    halves = spark.sql("SELECT CAST(0.25 AS DECIMAL(10,2)) AS s, 10L AS n, 0L AS none")
    row = halves.select(
        numbers.exact_ratio(F.col("s"), F.col("n")), numbers.exact_ratio(F.col("s"), F.col("none"))
    ).first()
    assert [str(v) for v in row] == ["0.03", "None"]


def test_changes_and_tone(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (110D, 100D), (101D, 100D), (90D, 100D), (5D, 0D), (5D, NULL) t(c, p)"
    )
    change = numbers.pct_change(F.col("c"), F.col("p"))
    got = rows(df.select(change, numbers.spending_tone(change)))
    assert [t for _, t in got] == ["bad", "neutral", "good", "neutral", "neutral"]
    assert got[0][0] == pytest.approx(0.1) and got[3][0] is None and got[4][0] is None


def test_market_bucket(spark):
    items = ["Total", "Swift", "Atacadão", " Pão de Açúcar ", "Mercado ½", "Assaí", "日本"]

    def key(name):
        return unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().strip().lower()

    expected = ["total", "swift", "atacadao"] + [
        str(zlib.crc32(key(n).encode()) % 5) for n in items[3:]
    ]
    assert values(spark, items, text.market_bucket("s")) == expected
    assert values(spark, items, text.market_key("s")) == [key(n) for n in items]


def test_receipt_numbers_and_dates(spark):
    amounts = ["1.234,56", "R$ 4,50", "12", "x", "0,750"]
    assert values(spark, amounts, receipts.parse_br_number("s")) == [1234.56, 4.5, 12.0, None, 0.75]
    days = ["24/05/2026", "1/2/2026", "2026-05-24", "31/02/2026"]
    assert values(spark, days, receipts.parse_br_date("s")) == [
        date(2026, 5, 24), date(2026, 2, 1), None, None,
    ]


def test_receipt_lines(spark):
    lines = ["MANTEIGA 6 x 7,30", "MACA 0,420 kg x 9,80", "TORRADA 160G", "CAFE 3KG 2 X R$ 1.030,00"]
    assert values(spark, lines, receipts.line_quantity("s")) == [6.0, 0.42, 1.0, 2.0]
    assert values(spark, lines, receipts.line_unit_price("s")) == [7.3, 9.8, None, 1030.0]
    names = ["TORRADA FINA 160G", "NECTAR DE PERA 1,5L", "PEIXE KG", "PAO 8 UN"]
    assert values(spark, names, receipts.strip_pack_size("s")) == [
        "TORRADA FINA", "NECTAR DE PERA", "PEIXE", "PAO",
    ]
    kinds = ["SUBTOTAL 10,00", "Total R$ 3", "TROCO 1", "CARTÃO 4", "CPF 1", "TOTALIZADOR X", "LEITE", None]
    assert values(spark, kinds, receipts.is_product_line("s")) == [
        False, False, False, False, False, True, True, False,
    ]


def test_receipt_keys_and_urls(spark):
    key = "12345678901" * 4
    blocks = " ".join(key[i : i + 4] for i in range(0, 44, 4))
    items = [key, blocks, key[:-1], key + "0", "x" * 44, ""]
    assert values(spark, items, receipts.clean_access_key("s")) == [key, key] + [None] * 4
    urls = ["https://a.b/c?p=1|2", "http://a.b/c?x=1&p=2", "ftp://a?p=1", "https://a/?xp=1", "", None]
    assert values(spark, urls, receipts.valid_receipt_url("s")) == [True, True] + [False] * 4


def test_two_digit_years_and_short_named_dates(spark):
    cases = {
        "01/02/99": date(1999, 1, 2), "31/12/98": date(1998, 12, 31), "01/02/26": date(2026, 1, 2),
        "18-Apr-26": date(2026, 4, 18), "15 mar 99": date(1999, 3, 15), "Jan 5, 26": date(2026, 1, 5),
        "JANUARY 5 2026": date(2026, 1, 5), "sept 3, 2026": date(2026, 9, 3), "Janch 5 2026": None,
        "Marly 5 2026": None,
    }
    assert values(spark, list(cases), dates.parse_purchase_date("s")) == list(cases.values())


def test_receipt_packs_totals_and_prices(spark):
    lines = {
        "SUCO 2X500ML 5 x 3,20": (5.0, 3.2, None, True),
        "AGUA 12X350ML 1 x 39,90 39,90": (1.0, 39.9, 39.9, True),
        "QUEIJO 0,250 kg x R$ 40,00 R$ 10,00": (0.25, 40.0, 10.0, True),
        "PAO 7,25": (1.0, None, 7.25, True),
        "SEM PRECO 2X500ML": (1.0, None, None, False),
        "13 x 1.030,00 13.390,00": (13.0, 1030.0, 13390.0, True),
    }
    columns = [f("s") for f in (
        receipts.line_quantity, receipts.line_unit_price, receipts.line_total, receipts.shows_price
    )]
    for k, column in enumerate(columns):
        assert values(spark, list(lines), column) == [v[k] for v in lines.values()]
    assert values(spark, ["SUCO 2X500ML", "AGUA 12 X 1,5L"], receipts.strip_pack_size("s")) == ["SUCO", "AGUA"]


def test_products_that_begin_like_other_lines(spark):
    kinds = {
        "TOTAL FLEX 1 x 5,00": True, "PIX DOCE 200G 3,00": True, "CARTAO POSTAL 2 x 1,50": True,
        "TOTAL 10,00": False, "Subtotal: R$ 9,00": False, "CARTÃO DE CRÉDITO 50,00": False,
        "VALOR A PAGAR R$ 1,00": False, "QTD. TOTAL DE ITENS 5": False, "TROCO": False,
        "CPF CONSUMIDOR: 123.456.789-00": False,
    }
    assert values(spark, list(kinds), receipts.is_product_line("s")) == list(kinds.values())


def test_common_dates_and_names_are_as_by_the_general_rules(spark):
    days = ["2026-02-03", "2026-02-03 10:30:00", "2026-02-30", "12/05/1995", "13/05/1995", "05.31.1995",
            "31-12-1995", "19950531", "19951331", "00010101", "May 5, 1995", "Sep 31, 1995", "Dec 05, 1995",
            "Jan 0, 1995", "13/13/1995", None]
    fast, general = dates.date_of(F.col("s")), dates._any_form(F.col("s"))
    assert values(spark, days, fast) == values(spark, days, general)
    names = ["old ring 947", "OLD RING-947KG", "supplier#000000947", "(abc 1a) b-c", "'x 2l", " a  b ", "",
             "PÃO DE AÇÚCAR 2kg", None]
    marked = F.replace(
        F.initcap(F.regexp_replace("s", text._UNCASED, f"$1{text._BREAK}")), F.lit(text._BREAK), F.lit("")
    )
    assert values(spark, names, text.capitalised("s")) == values(spark, names, marked)


def test_strip_looks_at_both_ends_before_it_searches(spark):
    """Texts that begin and end with any character, one that is not visible ASCII included."""
    ends = ["", "a", "~", "!", " ", "\x00", "\x1f", "\x7f", "\x80", "\x85", "\xa0", "\u2003", "é", "\U0001f600"]
    items = [f"{a}{m}{b}" for a in ends for m in ("", "x y") for b in ends] + [None]
    got = values(spark, items, text.strip("s"))
    assert got == [None if s is None else s.strip() for s in items]
    df = spark.createDataFrame([("a",)], "s string")
    plan = df.select(text.strip("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan


def test_strip_of_numbers_and_collated_texts(spark):
    df = spark.sql("SELECT 1.50D n, '\u00a0x ' COLLATE UNICODE_CI_AI s")
    assert df.select(text.strip("n"), text.strip("s")).first()[:] == ("1.5", "x")
