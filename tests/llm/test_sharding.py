import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tillroll.llm import sharding
from tillroll.llm.registry import op3_shards


def by_hand(rows, shards, tolerance):
    """(doc_id, text) -> shard, slot of records in the order of group and id."""
    keyed = sorted(
        (hashlib.md5((t or "").encode()).hexdigest(), i, len((t or "").encode()) + 1) for i, t in rows
    )
    total, groups = sum(k[2] for k in keyed), Counter()
    for g, _, size in keyed:
        groups[g] += size
    out, begin, before, seen = [], {}, 0, Counter()
    for g, i, size in keyed:
        begin.setdefault(g, before)
        whole = groups[g] <= int(tolerance * total / shards)
        twice = 2 * begin[g] + groups[g] if whole else 2 * before + size
        shard = min(shards - 1, twice * shards // (2 * total))
        out.append((i, size, shard, seen[shard]))
        seen[shard] += 1
        before += size
    return sorted(out)


@pytest.mark.parametrize("rows_per_range", [3, 250_000])
@pytest.mark.parametrize("tolerance", [0.005, 0.3])
def test_a_hot_group_and_small_groups(spark, rows_per_range, tolerance):
    rows = [(i, "hot text") for i in range(400)]
    rows += [(1000 + i, f"text {i // 2} " * (1 + i % 7)) for i in range(800)]
    rows += [(5000, "long " * 300)]
    keyed = spark.createDataFrame(rows, "i long, text string").select(
        "i", F.md5("text").alias("g"), (F.octet_length("text") + 1).cast("long").alias("size")
    )
    found = sharding.assign(keyed, 16, tolerance, rows_per_range, 8).collect()
    got = sorted((r.i, r.size, r.shard, r.slot) for r in found)
    assert got == by_hand(rows, 16, tolerance)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 1501 + tolerance * sum(sizes.values()) / 8


def test_ranges_are_subdivided_until_they_fit(spark):
    keyed = spark.range(3000).select(
        F.col("id").alias("i"), F.md5(F.lit("x")).alias("g"),
        F.when(F.col("id") < 10, 10_000).otherwise(1).cast("long").alias("size"),
    )
    out = sharding.assign(keyed, 4, 0.005, 100, 4).collect()
    assert sorted(r.i for r in out) == list(range(3000))


def test_edge_cases(spark):
    long = "x" * 300_000
    rows = [(None, None, "a"), (1, "", "b"), (2, long, "c"), (2, long, "c"), (3, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard_documents(docs).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 3, 300_001, 300_001]
    assert {r.text_crc32 for r in out} == {0, zlib.crc32("é".encode()), zlib.crc32(long.encode())}
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_query_sizes_are_near_equal(spark):
    sizes = Counter()
    largest = 0
    for r in op3_shards(spark, "/root/testdata/sf0.1").collect():
        sizes[r.shard] += r.size
        largest = max(largest, r.size)
    mean = sum(sizes.values()) / 16
    assert set(sizes) == set(range(16))
    assert max(abs(s - mean) for s in sizes.values()) <= largest / 2 + 0.01 * mean


def test_no_python_in_the_plan(spark):
    plan = op3_shards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
