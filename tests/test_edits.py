from datetime import date
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillroll.operators import edits

COLUMNS = (
    "id bigint, purchase_date date, product_id string, quantity decimal(10,3), "
    "unit_price decimal(10,2), product_price decimal(10,2), market_id string, "
    "access_key string, nfce_url string"
)


def line(
    id_, product="Leite", price="10.00", market="M1", day=date(2026, 1, 1), qty="1", unit="10", key=None
):
    def number(v):
        return None if v is None else Decimal(v)

    return (id_, day, product, number(qty), number(unit), number(price), market, key, None)


@pytest.fixture(scope="module")
def original(spark):
    return spark.createDataFrame([line(i) for i in range(1, 7)], COLUMNS)


def ops(spark, original, edited):
    diff = edits.diff_purchases(original, spark.createDataFrame(edited, COLUMNS))
    return sorted((r["op"], r["id"]) for r in diff.collect())


def test_classes_of_change(spark, original):
    edited = [
        line(1),
        line(2, price="11.00"),
        line(3, key="  "),  # blank receipt data equals none
        line(4, product=" "),  # blanked: the old line stays
        line(5, qty=None, unit=None),
        line(None, product=" pão ", price="8.00"),
        line(None, product=""),  # an added blank line is ignored
        line(99),
    ]
    assert ops(spark, original, edited) == [
        ("deleted", 6), ("inserted", None), ("unchanged", 1), ("unchanged", 3), ("unchanged", 4),
        ("unknown", 99), ("updated", 2), ("updated", 5),
    ]


def test_no_change_is_no_change(spark, original):
    diff = edits.diff_purchases(original, original)
    assert rows(edits.change_counts(diff)) == [("unchanged", 6)]
    merged = edits.apply_purchase_edits(original, original)
    assert sorted(rows(merged)) == sorted(rows(original))


def test_null_numbers_are_equal(spark):
    holes = spark.createDataFrame([line(1, qty=None, unit=None)], COLUMNS)
    assert rows(edits.change_counts(edits.diff_purchases(holes, holes))) == [("unchanged", 1)]


def test_changed_lines_are_cleaned(spark, original):
    edited = spark.createDataFrame(
        [line(1, product=" coca-cola ", price=None, qty="3", unit="5.20"),
         line(None, product=" pão ", price="9.00", qty="0", unit=None, market="m2")],
        COLUMNS,
    )
    result = edits.apply_purchase_edits(original.where("id = 1"), edited)
    shown = ("product_id", "quantity", "unit_price", "product_price", "market_id")
    got = rows(result.orderBy(F.col("id").isNull()), *shown)
    assert [tuple(map(str, r)) for r in got] == [
        ("Coca-Cola", "3.000", "5.20", "15.60", "M1"),
        ("Pão", "1.000", "9.00", "9.00", "M2"),
    ]


def test_new_ids_stay_below_imported_ones(spark):
    added = spark.createDataFrame([line(None) for _ in range(50)], COLUMNS).repartition(4)
    diff = edits.cleaned_changes(edits.diff_purchases(added.limit(0), added))
    ids = [r[0] for r in rows(edits.inserted_lines(diff, below=-10), "id")]
    assert len(set(ids)) == 50 and max(ids) < -10
