import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import near
from tillroll.llm.registry import op7_near

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    words = WORD.findall((text or "").encode().lower())
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def by_hand(rows, n, percent):
    """{doc_id: (size, component)} by comparing every two documents that share a shingle."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    classes = defaultdict(list)
    for i, s in sets.items():
        classes[s].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(x, y):
        x, y = sorted((find(x), find(y)))
        root[y] = x

    where = defaultdict(list)
    for s, ids in classes.items():
        for i in ids[1:] if s else []:
            join(ids[0], i)
        for g in s:
            where[g].append(min(ids))
    for s, ids in classes.items():
        common = defaultdict(int)
        for g in s:
            for j in where[g]:
                common[j] += 1
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                join(min(ids), j)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(rows, found, n=3, percent=85):
    expected = by_hand(rows, n, percent)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    found = op7_near(spark, "/root/testdata/sf0.01").collect()
    check([(d.doc_id, d.text) for d in docs], found)
    assert sum(not r.kept for r in found) > 20


@pytest.mark.parametrize("block, centers", [(512, 64), (7, 2)])
def test_chains_hubs_and_copies(spark, monkeypatch, block, centers):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "CENTERS", centers)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, next_id = [], 0

    def add(text):
        nonlocal next_id
        rows.append((next_id, text))
        next_id += 1

    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 160))]
        for _ in range(rng.randint(1, 25)):  # copies near the base, not always each other
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add(" ".join(copy))
        chain = list(base)
        for _ in range(8):  # each near the one before only
            chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
            add(" ".join(chain).upper() if rng.random() < 0.3 else "\n".join(chain))
    for _ in range(300):
        add("the very same text of a hot group")
    add("The  VERY same text of a hot group")
    rng.shuffle(rows)
    for n, percent in ((3, 85), (5, 80)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        check(rows, near.groups(docs, n, percent).collect(), n, percent)


def test_signature_distance_has_no_gaps():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**16, near.SYMBOLS).astype(np.uint16)
    for _ in range(500):
        other = base.copy()
        places = rng.choice(near.SYMBOLS, near.MOST_ERRORS, replace=False)
        other[places] ^= rng.integers(1, 2**16, near.MOST_ERRORS).astype(np.uint16)
        keys = near.bucket_keys(np.stack([base, other]))
        same = np.nonzero(keys[0] == keys[1])[0]
        assert len(same)
        first = near.first_shared_key((base != other)[None, :])
        assert first[0] == same[0] and keys[0][same[0]] & 63 == same[0]


def test_edge_cases(spark):
    long = " ".join(f"x{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one two", "d"), (5, "ONE\ttwo", "e"),
        (6, long, "f"), (7, long + " end", "g"), (7, long + " end", "g"), (None, "one two", "h"),
        (None, None, "i"), (8, "É two three", "j"), (9, "é two three", "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = near.groups(docs, 3, 85).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 4, 6, 6, 8, 9]
    assert [by_id[i].n_shingles for i in (1, 4, 6)] == [0, 1, 977]
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert near.groups(docs.limit(0), 3, 85).count() == 0
    with pytest.raises(ValueError, match="percent"):
        near.groups(docs, 3, 50)


def test_components_of_a_long_path(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    links = [tuple(rng.sample(x, 2)) for x in links]
    found = near.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r.node: r.component for r in found} == {
        **{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100
    }


def test_a_run_of_more_than_two_gib_keeps_its_rows():
    # all batches show the same zeros, which nothing reads
    half = 600 << 20
    zeros = pa.py_buffer(np.zeros(2 * half, np.uint8))
    offsets = pa.py_buffer(np.array([0, half, 2 * half], np.int32))
    sets = pa.Array.from_buffers(pa.binary(), 2, [None, offsets, zeros])
    numbers = [([7, 8], [1, 2]), ([8, 8], [3, 4]), ([8, 8], [5, 6]), ([8, 9], [7, 8]), ([9, 10], [9, 10])]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), sets], names=["group", "node", "set"])
        for g, n in numbers
    ]
    runs = [r["node"].to_pylist() for r in near._runs_of(iter(batches), ("group",))]
    assert runs == [[2, 3, 4, 5, 6, 7], [8, 9]]


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(24):
        copy = list(words)
        copy[rng.randrange(300)] = f"other{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "BLOCK_BYTES", 10_000)
    seen = []
    blocked = near._blocked
    monkeypatch.setattr(near, "_blocked", lambda *a: seen.append(blocked(*a)) or seen[-1])
    check(rows, near.groups(docs, n=3, percent=85).collect())
    assert max(x.select("low", "high").distinct().count() for x in seen) > 1


def test_a_large_group_is_contracted_before_its_blocks_meet(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(6000):
        copy = list(words)
        copy[rng.randrange(120)] = f"other{i}"
        rows.append((i, " ".join(copy)))
    drift = list(words)  # each near the one before, the last ones to none of the group
    for i in range(40):
        drift[i * 3] = f"drift{i}"
        rows.append((6000 + i, " ".join(drift)))
    rng.shuffle(rows)
    compared = []
    blocked = near._blocked
    monkeypatch.setattr(near, "_blocked", lambda *a: compared.append(blocked(*a)) or compared[-1])
    started = time.monotonic()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near.groups(docs, n=3, percent=85).collect()
    took = time.monotonic() - started
    assert len(found) == len(rows) and {r.component_id for r in found} == {0}
    # confirming: once as a member, a share as centers, and what stays apart
    assert sum(x.count() for x in compared[-2:]) < 5 * len(rows)
    assert took < 120  # about 50 seconds on eight cores
