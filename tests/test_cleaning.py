from datetime import date

import pytest
from conftest import rows
from pyspark.errors import PySparkException

from tillroll.operators import cleaning

RAW = (
    "id bigint, purchase_date string, product_id string, product_price string, quantity string, "
    "unit_price string, market_id string, access_key string, nfce_url string"
)


def raw_line(id_, price, qty, unit, day="2026-04-18", product="Arroz", key=None, url=None):
    return (id_, day, product, price, qty, unit, " feira livre ", key, url)


CASES = [
    (raw_line(1, "22.40", "4", "5.60", product=" arroz "), ("Arroz", "4.000", "5.60", "22.40")),
    (raw_line(2, None, "5", "3.30"), ("Arroz", "5.000", "3.30", "16.50")),
    (raw_line(3, "13.50", None, None), ("Arroz", "1.000", "13.50", "13.50")),
    (raw_line(4, "10", "-2", ""), ("Arroz", "1.000", "10.00", "10.00")),
    (raw_line(5, "9.00", "3", "5.00"), ("Arroz", "3.000", "5.00", "9.00")),
    (raw_line(7, "abc", "2", "4.00"), ("Arroz", "2.000", "4.00", "8.00")),
    (raw_line(8, "5.00", "1", "5.00", product="coca-cola 2l"), ("Coca-Cola 2L", "1.000", "5.00", "5.00")),
    (raw_line(10, None, "0.750", "12.90"), ("Arroz", "0.750", "12.90", "9.68")),
    (raw_line(11, "64.01", "2", None), ("Arroz", "2.000", "32.01", "64.01")),
    # A tiny quantity divides the total before it is itself rounded away.
    (raw_line(13, "1.00", "0.0004", None), ("Arroz", "0.000", "2500.00", "1.00")),
]


def test_amounts_and_names(spark):
    raw = spark.createDataFrame([line for line, _ in CASES], RAW)
    cleaned = cleaning.accepted(cleaning.clean_purchases(raw))
    got = {
        r["raw_id"]: (r["product_id"], str(r["quantity"]), str(r["unit_price"]), str(r["product_price"]))
        for r in cleaned.collect()
    }
    assert got == {line[0]: expected for line, expected in CASES}
    assert {r["market_id"] for r in cleaned.collect()} == {"Feira Livre"}


def test_dates_and_receipt_data(spark):
    raw = spark.createDataFrame(
        [
            raw_line(9, "5.00", "1", "5.00", key="nan", url=""),
            raw_line(12, "5.00", "1", "5.00", day="01/02/2026", key=" 3524 ", url="https://x?p=1"),
        ],
        RAW,
    )
    got = rows(
        cleaning.clean_purchases(raw).orderBy("raw_id"), "purchase_date", "access_key", "nfce_url"
    )
    assert got == [
        (date(2026, 4, 18), None, None),
        (date(2026, 1, 2), "3524", "https://x?p=1"),
    ]


def test_rejects_carry_a_reason(spark):
    raw = spark.createDataFrame(
        [
            raw_line(1, "abc", None, None),
            raw_line(2, "5", "1", "5", day="bad"),
            raw_line(3, "5", "1", "5", product="  "),
            raw_line(4, "1e12", "1", "5"),
            raw_line(5, "5", "1", "5"),
        ],
        RAW,
    )
    cleaned = cleaning.clean_purchases(raw)
    assert sorted(rows(cleaning.rejected(cleaned), "raw_id", "reason")) == [
        (1, "price"), (2, "date"), (3, "product"), (4, "price"),
    ]
    assert rows(cleaning.accepted(cleaned), "raw_id") == [(5,)]


def test_strict_fails_on_an_unreadable_date(spark):
    raw = spark.createDataFrame([raw_line(2, "5", "1", "5", day="bad")], RAW)
    with pytest.raises(PySparkException, match="unreadable purchase_date"):
        cleaning.clean_purchases(raw, strict=True).collect()


def test_raw_without_optional_columns(spark):
    raw = spark.createDataFrame([raw_line(1, "4", "9", "9")], RAW)
    cleaned = cleaning.clean_purchases(raw.drop("quantity", "unit_price", "access_key", "nfce_url"))
    row = cleaned.first()
    assert (str(row["quantity"]), str(row["unit_price"]), row["access_key"]) == ("1.000", "4.00", None)


def test_total_is_derived_only_without_the_column(spark):
    df = spark.createDataFrame([("2", "4.5"), ("x", "1")], "quantity string, unit_price string")
    assert rows(cleaning.derive_total(df), "product_price") == [(9.0,), (None,)]
    blank = df.selectExpr("*", "'' AS product_price")
    assert rows(cleaning.derive_total(blank), "product_price") == [("",), ("",)]


def test_conform_receipt(spark):
    df = spark.createDataFrame(
        [("x", "2026-03-09", "Pêra", "1.5"), ("y", "never", None, "a")],
        "note string, purchase_date string, product_id string, quantity string",
    )
    conformed = cleaning.conform_receipt(df)
    assert conformed.columns == [
        "purchase_date", "product_id", "quantity", "unit_price", "product_price", "market_id",
        "access_key", "nfce_url", "note",
    ]
    assert rows(conformed, "purchase_date", "quantity", "unit_price") == [
        (date(2026, 3, 9), 1.5, None), (None, None, None),
    ]


def test_unprocessed_skips_manual_ids(spark):
    raw = spark.range(5).toDF("id")
    taken = spark.createDataFrame([(0,), (1,), (1,)], "raw_id bigint")
    also = spark.createDataFrame([(3,)], "raw_id bigint")
    left = cleaning.unprocessed_raw(raw, taken, also)
    assert sorted(rows(left)) == [(0,), (2,), (4,)]
    assert sorted(rows(cleaning.distinct_processed_ids(taken, also))) == [(1,), (3,)]
