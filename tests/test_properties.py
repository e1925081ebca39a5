"""Random sets with one product and market holding most lines, against plain Python."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from conftest import LINES, rows
from pyspark.sql import functions as F

from tillroll.operators import gaps, prices, recurrence, silver


def random_lines(seed, n):
    rng = random.Random(seed)
    start = date(2025, 1, 1)
    return [
        (
            i,
            start + timedelta(days=rng.randrange(120)),
            "hot" if rng.random() < 0.4 else f"p{rng.randrange(12)}",
            Decimal(rng.randrange(1, 5000)) / 100,
            "main" if rng.random() < 0.4 else f"m{rng.randrange(5)}",
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module", params=[(1, 400), (2, 37), (3, 1500)], ids=str)
def case(request, spark):
    lines = random_lines(*request.param)
    return lines, spark.createDataFrame(lines, LINES).repartition(5)


def plain_gaps(lines, key):
    days = defaultdict(list)
    for line in lines:
        days[key(line)].append(line[1])
    return {
        k: [(b - a).days for a, b in zip(sorted(d), sorted(d)[1:], strict=False)]
        for k, d in days.items()
    }


def test_gaps(case):
    lines, df = case
    expected = Counter(
        (k, g) for k, found in plain_gaps(lines, lambda x: x[2]).items() for g in found
    )
    keys = ["product_id"]
    got = gaps.recurrence_gaps(gaps.day_blocks(df, keys), keys)
    assert {(p, g): n for p, g, n in rows(got)} == expected
    per_line = gaps.purchase_gaps(gaps.daily_counts(df, keys), keys)
    assert per_line.agg(F.sum("n")).first()[0] == len(lines)


def test_gaps_over_block_borders(spark):
    """Before 1970, at the first and last bit of a block, and over empty blocks."""
    days = [-200, -129, -128, -65, -64, -63, -1, 0, 1, 62, 63, 64, 64, 64, 127, 128, 1000]
    lines = [(i, date(1970, 1, 1) + timedelta(days=d), "A", Decimal(1), "M") for i, d in enumerate(days)]
    blocks = gaps.day_blocks(spark.createDataFrame(lines, LINES), ["product_id"])
    expected = Counter(b - a for a, b in zip(days, days[1:], strict=False))
    assert {g: n for _, g, n in rows(gaps.recurrence_gaps(blocks, ["product_id"]))} == expected


def test_curve(case):
    lines, df = case
    scopes = {"Total": [g for f in plain_gaps(lines, lambda x: x[2]).values() for g in f]}
    for (market, _), found in plain_gaps(lines, lambda x: (x[4], x[2])).items():
        scopes.setdefault(market, []).extend(found)
    expected = {
        (s, d): sum(g <= d for g in found) / len(found)
        for s, found in scopes.items() if found for d in range(61)
    }
    assert {(s, d): p for s, d, p in rows(recurrence.recurrence_curve(df).drop("is_whole"))} == expected


def test_alerts(case):
    lines, df = case
    expected = {}
    for product in {line[2] for line in lines}:
        own = sorted((line[1], line[0], float(line[3])) for line in lines if line[2] == product)
        if len(own) > 1:
            prior = sum(p for _, _, p in own[:-1]) / (len(own) - 1)
            if (own[-1][2] - prior) / prior > 0.15:
                expected[product] = ((own[-1][2] - prior) / prior, own[-1][0])
    got = {r["product_id"]: r for r in prices.price_alerts(df, limit=None).collect()}
    assert set(got) == set(expected)
    for product, (variation, day) in expected.items():
        assert got[product]["variation_pct"] == pytest.approx(variation)
        assert got[product]["last_purchase_date"] == day


def test_totals_agree(case):
    lines, df = case
    total = sum(line[3] for line in lines)
    for stats in (silver.market_stats(df), silver.monthly_spending(df)):
        assert stats.agg(F.sum("total_spent")).first()[0] == total
    stats = silver.product_stats(df, "2026-01-01")
    found = plain_gaps(lines, lambda x: x[2])
    for row in stats.collect():
        own = found[row["product_id"]]
        expected = round(sum(own) / len(own), 2) if own else None
        got = row["avg_days_purchase"]
        assert (got is None and expected is None) or float(got) == pytest.approx(expected, abs=0.0051)


def test_partitioning_does_not_matter(case):
    _, df = case
    other = df.coalesce(1).orderBy(F.desc("product_price"))
    for build in (
        lambda d: silver.product_stats(d, "2026-01-01"),
        silver.market_stats,
        recurrence.recurrence_curve,
        lambda d: prices.price_alerts(d, limit=None),
    ):
        assert sorted(map(str, rows(build(df)))) == sorted(map(str, rows(build(other))))
