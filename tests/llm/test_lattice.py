import math

import numpy as np
import pytest

from tillroll.llm import lattice
from tillroll.llm.registry import op13_lattice

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<double>"


def by_hand(rows, percent=95):
    """{position: (links, component)} by comparing every two vectors."""
    units = []
    for _, v in rows:
        good = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / np.max(np.abs(v)) if good else None)
    near = [[] for _ in rows]
    for a, x in enumerate(units):
        for b, y in enumerate(units):
            if a != b and x is not None and y is not None and len(x) == len(y):
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= percent / 100 - 1e-15:
                    near[a].append(b)
    out = {}
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out[a] = (len(near[a]), min(ids, default=None))
    return out


def check(spark, rows, kinds=KINDS):
    found = lattice.groups(spark.createDataFrame(rows, kinds)).collect()
    expected = sorted(
        ((rows[k][0] is None, rows[k][0] or 0), n, c is None, c or 0)
        for k, (n, c) in by_hand([r[:2] for r in rows]).items()
    )
    got = sorted(
        ((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id is None, r.component_id or 0)
        for r in found
    )
    assert got == expected
    for r in found:
        assert r.kept == (None in (r.vec_id, r.component_id) or r.vec_id == r.component_id)


def around(rng, centre, count, noise):
    return centre + noise * rng.normal(size=(count, len(centre))) / math.sqrt(len(centre))


def test_decoding_gives_the_nearest_point():
    rng = np.random.default_rng(5)
    x = 3 * rng.normal(size=(500, 8))
    points = lattice.decoded(x)
    doubled = 2 * points
    assert np.all(doubled == np.rint(doubled)) and np.all(points.sum(axis=1) % 2 == 0)
    assert np.all((doubled % 2).sum(axis=1) % 8 == 0)  # all whole or all halves
    distance = ((x - points) ** 2).sum(axis=1)
    steps = ((x[:, None] - points[:, None] - lattice.ROOTS[None]) ** 2).sum(axis=2).min(axis=1)
    assert len(lattice.ROOTS) == 240
    assert np.all(distance <= steps + 1e-9) and distance.max() <= 1 + 1e-9


@pytest.mark.parametrize(("cosine", "least"), [(0.95, 0.98), (0.97, 0.998)])
def test_pairs_meet(cosine, least):
    rng = np.random.default_rng(6)
    a = lattice.units_of(rng.normal(size=(4000, 64)))
    b = rng.normal(size=a.shape)
    b = lattice.units_of(b - (a * b).sum(axis=1, keepdims=True) * a)
    x, y = lattice.cells(a), lattice.cells(cosine * a + math.sqrt(1 - cosine**2) * b)
    assert (lattice._first_meeting(x, y) != 0).mean() >= least
    assert (lattice._first_meeting(x, y) == lattice._first_meeting(y, x)).all()


def test_far_pairs_hardly_meet():
    x = lattice.cells(lattice.units_of(np.random.default_rng(7).normal(size=(8000, 64))))
    met = [(lattice._first_meeting(x[:-k], x[k:]) != 0).mean() for k in (1, 2, 3)]
    assert np.mean(met) <= 0.0002


def test_generated_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in op13_lattice(spark, SF).collect()}
    assert found == {rows[k][0]: x for k, x in by_hand(rows).items()}


def test_groups_of_every_tightness(spark):
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=(60, 32))]
    for noise in (0.05, 0.15, 0.22, 0.3):
        vectors.append(around(rng, rng.normal(size=32), 40, noise))
    flat = np.concatenate(vectors)
    flat = np.concatenate([flat, flat[70:90], 3.0 * flat[75:80]])
    ids = rng.permutation(len(flat)).tolist()
    check(spark, list(zip(ids, flat.tolist(), strict=True)))


@pytest.mark.parametrize("block", [16, 512])
def test_cores_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "CROWDED", 20)
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    flat = np.concatenate(
        [
            around(rng, centre, 150, 0.1),
            around(rng, centre, 60, 0.35),
            around(rng, rng.normal(size=16), 80, 0.2),
            rng.normal(size=(40, 16)),
        ]
    )
    flat = np.concatenate([flat, flat[:30]])
    check(spark, [(1000 - k, v) for k, v in enumerate(flat.tolist())])


def test_defined_cases(spark):
    one = [1.0, 2.0, -0.5, 0.0]
    rows = [
        (9, one),
        (4, [2 * x for x in one]),
        (4, one),
        (None, one),
        (7, [1e-200 * x for x in one]),
        (8, [1e300 * x for x in one]),
        (10, [1.0, 2.0, -0.5, -0.0]),
        (11, [1.0, 2.0, -0.5]),
        (12, None),
        (13, []),
        (14, [0.0, 0.0]),
        (15, [1.0, None]),
        (16, [1.0, math.nan]),
        (17, [math.inf, 1.0]),
        (None, [0.0, 1.0]),
        (18, [-1.0, -2.0, 0.5, 0.0]),
    ]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, one)])
    clashing = [(k, v, "x", 1, 2) for k, v in rows]
    check(spark, clashing, f"{KINDS}, node string, n_links int, Key int")
    with pytest.raises(ValueError):
        lattice.groups(spark.createDataFrame([], KINDS), percent=90)
