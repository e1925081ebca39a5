import random
from datetime import date
from decimal import Decimal

import pytest
from conftest import AS_OF, LINES, rows
from pyspark.sql import functions as F

from tillroll.operators import catalog, markets, prices, recurrence, restock, silver, trends
from tillroll.plans.registry import published


@pytest.fixture(scope="module")
def products(golden):
    return restock.with_buy_flag(silver.product_stats(golden, AS_OF)).cache()


@pytest.fixture(scope="module")
def market(golden):
    return silver.market_stats(golden).cache()


@pytest.fixture(scope="module")
def monthly(golden):
    return silver.monthly_spending(golden).cache()


def test_product_stats(golden):
    got = rows(published(silver.product_stats(golden, AS_OF)).orderBy("product_id"))
    assert got == [
        ("Arroz", "2026-02-01", 31.0, 21.0, 20.0, 22.0, 2, 9.0),
        ("Cafe", "2026-02-05", None, 30.0, 30.0, 30.0, 1, 5.0),
        ("Leite", "2026-01-22", 10.5, 11.0, 10.0, 13.0, 3, 19.0),
    ]


def test_spellings_of_one_name_are_merged(spark):
    lines = [
        (1, date(2026, 1, 1), "Café", 1, "Assaí"),
        (2, date(2026, 1, 3), "Cafe", 2, "Assai"),
        (3, date(2026, 1, 3), "CAFÉ ", 3, "ASSAÍ"),
    ]
    df = spark.createDataFrame(lines, LINES.replace("decimal(10,2)", "int")).withColumn(
        "product_price", F.col("product_price").cast("decimal(10,2)")
    )
    stats = published(silver.product_stats(df, "2026-01-10"))
    assert rows(stats, "product_id", "total_purchases", "avg_days_purchase", "avg_product_price") == [
        ("CAFÉ ", 3, 1.0, 2.0)
    ]
    assert rows(published(silver.market_stats(df)), "market_id", "total_spent", "visit_count") == [
        ("ASSAÍ", 6.0, 2)
    ]
    assert silver.product_stats(df, collation=None).count() == 3
    assert silver.market_stats(df, collation=None).count() == 3


def test_lines_without_a_date(spark):
    lines = [(1, None, "A", 1, "M"), (2, date(2026, 1, 3), "A", 2, "M"), (3, date(2026, 1, 7), "A", 4, "M")]
    lines.append((4, None, "B", 8, "N"))
    df = spark.createDataFrame(lines, LINES.replace("decimal(10,2)", "int"))
    assert rows(published(silver.market_stats(df)).orderBy("market_id")) == [
        ("M", 7.0, 3.5, 2, "2026-01-07"), ("N", 8.0, None, 0, None),
    ]
    stats = published(silver.product_stats(df, "2026-01-10")).orderBy("product_id")
    assert rows(stats, "avg_days_purchase", "total_purchases") == [(4.0, 3), (None, 1)]
    curve = recurrence.recurrence_curve(df, max_days=4)
    assert sorted(rows(curve.where("cumulative_pct > 0").drop("is_whole"))) == [("M", 4, 1.0), ("Total", 4, 1.0)]


def test_restock(products):
    assert rows(products.orderBy("product_id"), "product_id", "buy") == [
        ("Arroz", False), ("Cafe", False), ("Leite", True),
    ]
    assert rows(restock.due_list(products), "product_id", "overdue_days") == [("Leite", 8.5)]
    assert rows(restock.upcoming(products)) == []
    assert rows(restock.upcoming(products, 30)) == [("Arroz", 22.0)]
    progress = rows(restock.restock_progress(products), "product_id", "purchase_progress")
    assert progress == [("Leite", 150.0), ("Arroz", pytest.approx(9 / 31 * 100)), ("Cafe", 0.0)]
    assert rows(restock.restock_progress(products, 10), "product_id") == [("Arroz",), ("Cafe",)]
    assert len(rows(restock.restock_progress(products, 1, show_all=True))) == 3
    assert rows(restock.due_count(products)) == [(1, 3)]


def test_prices(golden, products):
    assert rows(prices.price_spread(products), "product_id", "spread") == [
        ("Leite", 3.0), ("Arroz", 2.0), ("Cafe", 0.0),
    ]
    alerts = rows(prices.price_alerts(golden))
    assert alerts == [("Leite", 13.0, 10.0, pytest.approx(0.3), date(2026, 1, 22))]
    assert len(rows(prices.price_alerts(golden, threshold=0.05))) == 2
    # The threshold itself is no alert.
    assert rows(prices.price_alerts(golden, threshold=0.1), "product_id") == [("Leite",)]
    assert rows(prices.price_history(golden, "Leite"), "id") == [(1,), (2,), (3,)]
    assert rows(prices.price_history(golden, None)) == []
    assert len(rows(prices.price_evolution(golden))) == 6
    assert len(rows(prices.price_evolution(golden, ["Cafe", "Arroz"]))) == 3
    assert rows(prices.price_summary(products, "Cafe"), "total_purchases") == [(1,)]
    assert rows(prices.price_summary(products, "Nada")) == []


def test_last_price_on_a_shared_day_is_the_largest_id(spark):
    lines = [(i, date(2026, 1, 1), "A", p, "M") for i, p in ((3, 30), (9, 90), (5, 50))]
    df = spark.createDataFrame(lines, LINES.replace("decimal(10,2)", "int"))
    assert rows(prices.last_and_prior(df), "last_price", "prior_avg_price") == [(90.0, 40.0)]


def test_markets(market):
    assert rows(published(market).orderBy("market_id")) == [
        ("M1", 65.0, 21.67, 3, "2026-02-01"), ("M2", 40.0, 20.0, 2, "2026-02-05"),
    ]
    assert rows(markets.market_share(market), "market_id", "share") == [
        ("M1", 65 / 105), ("M2", 40 / 105),
    ]
    assert rows(markets.market_totals(market)) == [(105.0, 5, 21.0, "M1")]
    assert rows(restock.ranked_top(market, "market_id", "avg_ticket", 1), "market_id") == [("M1",)]


def test_nothing_spent(market):
    none = market.limit(0)
    assert rows(markets.market_totals(none)) == [(0.0, 0, 0.0, None)]
    free = market.withColumn("total_spent", F.lit(0).cast("decimal(20,2)"))
    assert rows(markets.market_share(free), "share") == [(0.0,), (0.0,)]


def test_months(monthly):
    assert rows(published(monthly).orderBy("year_month")) == [
        ("2026-01", 53.0, 4, 13.25), ("2026-02", 52.0, 2, 26.0),
    ]
    assert rows(trends.monthly_trend(monthly), "rolling_avg") == [(53.0,), (52.5,)]
    latest = trends.month_over_month(monthly)
    assert rows(latest, "year_month", "total_spent_change", "tone") == [
        ("2026-02", pytest.approx(-1 / 53), "neutral")
    ]
    assert rows(trends.monthly_detail(monthly), "year_month") == [("2026-02",), ("2026-01",)]
    assert rows(trends.latest_and_previous(monthly), "year_month") == [("2026-02",), ("2026-01",)]


def test_one_month_has_no_change(monthly):
    first = monthly.where("year_month = '2026-01'")
    assert rows(trends.month_over_month(first), "total_spent_change", "tone") == [(None, "neutral")]


def test_recurrence(golden):
    curve = recurrence.recurrence_curve(golden).cache()
    points = {(s, d): p for s, d, p in rows(curve.drop("is_whole"))}
    assert len(points) == 122
    assert [points["Total", d] for d in (6, 7, 14, 31)] == [0.0, 1 / 3, 2 / 3, 1.0]
    assert [points["M1", d] for d in (20, 21, 31)] == [0.0, 0.5, 1.0]
    assert rows(recurrence.median_repurchase_days(curve)) == [(14.0,)]
    assert rows(recurrence.scope_list(curve)) == [("Total",), ("M1",)]
    assert rows(recurrence.median_repurchase_days(curve.where("days < 10"))) == [(None,)]
    short = recurrence.recurrence_curve(golden, max_days=10).where("scope = 'Total'")
    assert [p for _, d, p in sorted(rows(short.drop("is_whole")))] == [0.0] * 7 + [1 / 3] * 4
    chosen = recurrence.curve_for_scopes(golden)
    assert {r[0] for r in rows(chosen, "scope")} == {"Total", "M1"}
    assert {r[0] for r in rows(recurrence.curve_for_scopes(golden, ["M1"]), "scope")} == {"M1"}


def test_a_market_called_like_the_whole_set(golden):
    """Its gaps stay apart from those of the whole set."""
    plain = recurrence.recurrence_curve(golden)
    named = golden.replace("M1", "Total", "market_id")
    curve = recurrence.recurrence_curve(named)

    def points(df, whole):
        return sorted(rows(df.where(F.col("is_whole") == whole), "days", "cumulative_pct"))

    assert points(curve, True) == points(plain, True)
    assert points(curve, False) == points(plain, False)
    assert rows(recurrence.median_repurchase_days(curve)) == [(14.0,)]
    assert rows(recurrence.scope_list(curve)) == [("Total",), ("Total",)]
    assert recurrence.curve_for_scopes(named).count() == curve.count()


def test_headlines(products, market, monthly, golden):
    assert rows(trends.kpi_summary(products, market, monthly)) == [
        ("2026-02", 52.0, pytest.approx(-1 / 53), "neutral", 105.0, 2, 5, 21.0, 1, 3)
    ]
    header = trends.kpi_header(products, market, monthly).first()
    assert (header["most_bought"], header["purchases"]) == ("Leite", 3)
    assert (header["favourite_market"], header["visits"]) == ("M1", 3)
    assert header["days_since_purchase"] == 5.0 and len(header["series"]) == 2
    assert rows(trends.latest_purchase(golden)) == [(date(2026, 2, 5),)]
    assert rows(trends.latest_purchase(golden.limit(0))) == [(None,)]


def test_headlines_without_data(products, market, monthly):
    row = trends.kpi_summary(products.limit(0), market.limit(0), monthly.limit(0)).first()
    assert row["avg_ticket"] is None and row["latest_month"] is None and row["due"] == 0


def test_catalog(spark, products, golden):
    names = ["Leite", "Arroz", "Cafe"]
    assert [n for n, _ in rows(catalog.product_options(products))] == names
    assert [n for n, _ in rows(catalog.product_options(products.limit(0), golden))] == names
    assert rows(catalog.known_products(products)) == [("Arroz",), ("Cafe",), ("Leite",)]
    assert rows(catalog.known_products(products.limit(0), ["Pêra", "", "Uva"])) == [
        ("Pêra",), ("Uva",),
    ]
    names = [(1, " café"), (2, "LEITE "), (3, "pão"), (4, None)]
    lines = spark.createDataFrame(names, "id int, product_id string")
    matched = catalog.match_known_products(lines, products)
    assert sorted(rows(matched, "id", "matched_name")) == [
        (1, "Cafe"), (2, "Leite"), (3, "Pão"), (4, None),
    ]


def test_table_page(products):
    page = restock.table_page(restock.restock_progress(products, show_all=True), 2)
    assert rows(page, "product_id", "total_rows") == [("Leite", 3), ("Arroz", 3)]


def test_similar_names(spark):
    known = spark.createDataFrame(
        [("Leite Integral", 5), ("Leite Interno", 9), ("Refrigerante", 4), ("Pão", 7), ("Sabonete", 2),
         ("Sabonetes", 8), ("Arroz", 3), ("Chá", 1), ("Aa", 1)],
        "product_id string, total_purchases long",
    )
    expected = {
        " leite  integral": ("Leite  Integral", "new"),
        "LEITE INTEGRAL": ("Leite Integral", "same"),
        "PAO": ("Pão", "same"),
        "LEITE INT": ("Leite Interno", "short"),
        "leite integ.": ("Leite Integral", "short"),
        "REFRIG": ("Refrigerante", "short"),
        "RE": ("Re", "new"),
        "Sabonte": ("Sabonete", "edited"),
        "Sabonetess": ("Sabonetes", "edited"),
        "Aroz": ("Arroz", "edited"),
        "Rrroz": ("Arroz", "edited"),
        "Arros Branco": ("Arros Branco", "new"),
        "Aab": ("Aa", "edited"),
        None: (None, None),
    }
    expected[" leite  integral"] = ("Leite Integral", "short")
    lines = spark.createDataFrame([(k, n) for k, n in enumerate(expected)], "id long, product_id string")
    for some in (lines, lines.unionByName(lines)):
        found = catalog.match_similar_products(some, known)
        assert found.count() == some.count()
        assert {r[0]: (r[1], r[2]) for r in rows(found, "product_id", "matched_name", "matched_by")} == expected
    nothing = catalog.match_similar_products(lines, known.limit(0))
    assert {r[0] for r in rows(nothing, "matched_by")} == {"new", None}


@pytest.mark.parametrize("edits", [1, 2])
def test_no_similar_name_is_missed(spark, edits):
    rng = random.Random(edits)
    least = 3 * edits - 1
    words = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    mine, theirs = words[::2], words[1::2]
    frames = [spark.createDataFrame([(w,) for w in x], "plain string") for x in (mine, theirs)]
    found = sorted(rows(catalog.similar_names(*frames, max_edits=edits)))
    assert found == sorted(
        (a, b, distance(a, b))
        for a in mine
        for b in theirs
        if min(len(a), len(b)) >= least and distance(a, b) <= edits
    )


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_product_names_are_sorted_by_collation_once(spark):
    df = spark.createDataFrame(
        [(date(2026, 1, 1), "Pao", Decimal("1.00")), (date(2026, 1, 3), "pão", Decimal("2.00"))],
        "purchase_date date, product_id string, product_price decimal(10,2)",
    )
    found = silver.product_stats(df, "2026-02-01")
    row = found.first()
    assert found.count() == 1 and (row["product_id"], row["total_purchases"]) == ("Pao", 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
