import math
from fractions import Fraction

import numpy as np
import pytest

from tillroll.llm import whiten
from tillroll.llm.registry import op12_whiten

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<double>"


def by_hand(rows, components=8):
    """n, whole numbers, exact covariance, and the scores, all from Python integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in rows]
    n, size = len(x), len(x[0])
    s = [sum(v[d] for v in x) for d in range(size)]
    deviations = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    v = np.array(
        [
            [float(Fraction(sum((n * r[d] - s[d]) * (n * r[e] - s[e]) for r in x), n**3)) for e in range(size)]
            for d in range(size)
        ]
    )
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s, strict=True)] for r in x])
    scores = centred @ axes[:, :components] / np.sqrt(values[:components])
    return deviations, scores, values[:components] / values.sum()


def check(rows, found, components=8):
    """``rows`` by id, of usable vectors only; results for each id and component."""
    deviations, scores, shares = by_hand([v for _, v in rows], components)
    assert len(found) == len(rows) * components
    got = {(r.vec_id, r.component): r for r in found}
    for k in range(components):
        column = np.array([got[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(column - s * scores[:, k]).max() for s in (1, -1)) < 1e-6
        assert math.isclose(got[rows[0][0], k + 1].explained, shares[k], rel_tol=1e-9)
    for (i, _), exact in zip(rows, deviations, strict=True):
        r = got[i, 1]
        assert (r.n, r.deviation, int(r.deviation_exact)) == (len(rows), exact, exact)
        assert r.identity_error < 1e-6


def test_generated_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, op12_whiten(spark, SF).collect())


@pytest.mark.parametrize("largest", [0, 1, 700, 2**30, 2**62])
def test_scatter_is_exact(largest):
    rng = np.random.default_rng(3)
    x = rng.integers(0, largest, (131, 5), endpoint=True)
    x[:, 2] = 0
    widths = [int(c).bit_length() for c in x.max(axis=0)]
    sums, products = whiten.scatter(x, widths)
    exact = x.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist()
    assert products.tolist() == np.triu(exact.T @ exact).tolist()


def test_bits_are_packed_by_row():
    planes = whiten.bit_planes(np.array([[1, 0], [3, 2]] * 70), [2, 2])
    assert planes.shape == (4, 3)
    assert np.bitwise_count(planes).sum(axis=1).tolist() == [140, 70, 0, 70]


def test_same_sums_in_any_order_and_dealing(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v) for k, v in enumerate((rng.normal(size=(300, 12)) * 5).tolist())]
    df = spark.createDataFrame(rows, KINDS)
    a = whiten.fit(whiten.usable(df.repartition(7)))
    b = whiten.fit(whiten.usable(df.orderBy("embedding").coalesce(1)))
    assert (a.n, a.low, a.sums, a.trace) == (b.n, b.low, b.sums, b.trace)
    assert (a.components == b.components).all()
    check(rows, whiten.whiten(df).collect())


def test_defined_cases(spark):
    rng = np.random.default_rng(5)
    good = [(k, v) for k, v in enumerate(rng.normal(size=(40, 9)).tolist())]
    bad = [
        (100, None),
        (101, []),
        (102, [None, *[1.0] * 8]),
        (103, [math.nan, *[1.0] * 8]),
        (104, [math.inf, *[1.0] * 8]),
        (105, [1.0] * 8),
    ]
    rows = [(i, v, "x", 1) for i, v in good + bad]
    df = spark.createDataFrame(rows, f"{KINDS}, component string, N int")
    check(good, whiten.whiten(df).collect())
    again = spark.createDataFrame(good + [good[0], (None, good[1][1])], KINDS)
    assert whiten.whiten(again).where("n = 42").count() == 42 * 8
    constant = [(k, [*v[:2], 5.0, v[0]]) for k, v in good]
    found = whiten.whiten(spark.createDataFrame(constant, KINDS)).collect()
    assert {r.component for r in found} == {1, 2}
    assert max(r.identity_error for r in found) < 1e-6
    for nothing in ([], bad[:5], [good[0]], [(k, [1.0, 2.0]) for k in range(5)]):
        assert whiten.whiten(spark.createDataFrame(nothing, KINDS)).collect() == []


def test_huge_entries(spark):
    rows = [(k, [float(k), (-1.0) ** k * 1e300]) for k in range(6)]
    found = whiten.whiten(spark.createDataFrame(rows, KINDS)).collect()
    assert {r.component for r in found} == {1}
    x = [2**61 * (-1) ** k for k in range(6)]
    assert {r.deviation for r in found} == {None}
    exact = (6 * x[0] - sum(x)) ** 2
    assert exact >= 10**38 and {r.deviation_exact for r in found} == {None}
    assert max(r.identity_error for r in found) < 1e-6
