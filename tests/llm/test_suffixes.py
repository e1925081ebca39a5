import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import chunks, suffixes
from tillroll.llm.registry import op5_suffixes, span_sum

PIECES = ["the ", "of a ", "é", "日本", "\n", "x", "and then ", "\x00", "🙂 ", "abc" * 4]


def by_hand(rows, length=50):
    """{doc_id: removed mask} for rows whose ids may repeat."""
    least, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - length + 1 if i is not None else 0):
            key = t[s : s + length]
            least[key] = min(least.get(key, i), i)
    for i, t in texts:
        mask = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1 if i is not None else 0):
            if least[t[s : s + length]] < i:
                mask[s : s + length] = True
        out.append((i, t, mask))
    return out


def digest(text, mask):
    spans = np.count_nonzero(np.diff(mask.astype(int), prepend=0) == 1)
    kept = bytes(np.frombuffer(text, np.uint8)[~mask]) if text else b""
    return len(text), int(mask.sum()), int(spans), hashlib.sha256(kept).hexdigest()


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    expected = {i: digest(t, m) for i, t, m in by_hand([(d.doc_id, d.text) for d in docs])}
    found = op5_suffixes(spark, "/root/testdata/sf0.01").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert len(found) == len(docs) and got == expected
    assert sum(r.n_removed for r in found) > 10_000


def some_rows(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(PIECES) for _ in range(n))
    passages = [text(rng.randint(5, 40)) for _ in range(14)] + ["a" * 300, "ab" * 90]
    rows = []
    for i in range(160):
        parts = [text(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : cut + rng.randint(1, len(p))], text(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(25)] + [(2 * i, rows[5 + i][1][10:]) for i in range(9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_bytes, most", [(600, 20_000), (2_000_000, 20_000), (600, 1), (900, 3)])
def test_passages_copies_and_runs(spark, monkeypatch, chunk_bytes, most):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(suffixes, "CONTEXTS_PER_CHUNK", 100_000)
    rows = some_rows(chunk_bytes)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffixes.remove(docs).withColumn("n", span_sum("spans")).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == sorted((i, *digest(t, m)) for i, t, m in by_hand(rows))


def test_chunks_are_bounded_by_rows_and_by_all_columns(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 20_000)
    wide = F.when(F.col("id") % 100 == 0, F.repeat(F.lit("x"), 9000)).otherwise("")
    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), wide.alias("w"))
    sizes = chunks.chunked(docs).select(F.explode("ids").alias("i"), "chunk").groupBy("chunk").agg(
        F.count("*").alias("n"), F.sum((F.col("i") % 100 == 0).cast("int")).alias("wide")
    ).collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) < 320
    assert max(r.wide for r in sizes) <= 2
    found = suffixes.remove(docs)
    assert found.count() == 3000 and found.filter("n_bytes = 0 and w = ''").count() == 2970


def test_an_anchor_of_many_contexts_is_divided(spark, monkeypatch):
    rng = random.Random(11)
    phrase = "".join(rng.choice("abcdefgh ") for _ in range(40))
    tails = ["".join(rng.choice("xyz") for _ in range(30)) for _ in range(900)]
    rows = [(i, f"{rng.choice('pqr') * 9}{phrase}{rng.choice(tails)}") for i in range(3000)]
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", 50)
    asked = []
    exchanged = suffixes.exchanged
    monkeypatch.setattr(suffixes, "exchanged", lambda *a: asked.append(a[3]) or exchanged(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.remove(docs).withColumn("n", span_sum("spans")).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == sorted((i, *digest(t, m)) for i, t, m in by_hand(rows))
    assert asked == ["shared", "merged", "strings"]


def test_many_contexts_of_one_anchor(spark):
    # the phrase alone repeats; 18 and 50 bytes around it are each document's own
    phrase = "a phrase of more than fifty bytes that every document has in it "
    unique = F.sha2(F.col("doc_id").cast("string"), 256)
    docs = spark.range(200_000).select(
        F.col("id").alias("doc_id"), F.concat(unique, F.lit(phrase), F.reverse(unique)).alias("text")
    )
    started = time.monotonic()
    found = suffixes.remove(docs).groupBy(span_sum("spans").alias("n")).count().collect()
    took = time.monotonic() - started
    assert sum(r["count"] for r in found) == 200_000
    least = min(found, key=lambda r: r.n)
    assert (least.n, least["count"]) == (0, 1) and all(r.n >= len(phrase) for r in found if r.n)
    assert took < 120


def test_whole_characters(spark):
    rows = some_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.remove(docs, whole_characters=True).select("doc_id", F.col("kept").cast("string").alias("t"))
    expected = []
    for i, t, mask in by_hand(rows):
        at, out = 0, ""
        for char in t.decode():
            size = len(char.encode())
            if not mask[at : at + size].all():
                out += char
            at += size
        expected.append((i, out))
    assert sorted((r.doc_id, r.t) for r in found.collect()) == sorted(expected)


def test_merge_is_sorted_with_right_prefixes():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(suffixes.CONTEXT)) for _ in range(40)]
    strings += [s[:30] + bytes(rng.choice(b"ab") for _ in range(suffixes.CONTEXT - 30)) for s in strings]
    runs = [sorted({rng.choice(strings) for _ in range(rng.randint(1, 30))}) for _ in range(11)]
    sources = []
    for run in runs:
        matrix = np.frombuffer(b"".join(run), np.uint8).reshape(-1, suffixes.CONTEXT)
        sources.append(suffixes.decoded_run(*suffixes.front_coded(matrix)))
    out = list(suffixes.merged(sources))
    plain = [s.to_bytes(suffixes.CONTEXT) for _, s, _ in out]
    assert plain == sorted(x for run in runs for x in run)
    for (shared, _, _), a, b in zip(out[1:], plain, plain[1:]):
        same = next((k for k in range(suffixes.CONTEXT) if a[k] != b[k]), suffixes.CONTEXT)
        assert shared == same
    assert list(suffixes.merged([])) == []


def test_edge_cases(spark):
    passage = "".join(chr(97 + i % 23) + str(i) for i in range(40))
    long = "".join(f"word{i % 3000} " for i in range(40_000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, passage, "c"), (3, passage, "c"), (None, passage, "d"),
        (4, "x" + passage, "e"), (5, long, "f"), (6, "short", "g"), (7, "short", "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shared string")
    found = suffixes.remove(docs).collect()
    kept = {(r.doc_id, r.shared): r.kept for r in found}
    assert len(found) == len(rows)
    assert kept[3, "c"] == passage.encode() and kept[None, "d"] == passage.encode()
    assert kept[4, "e"] == b"x" and kept[5, "f"] == long.encode() and kept[7, "h"] == b"short"
    assert kept[1, "a"] == b""
    assert suffixes.remove(docs.limit(0)).count() == 0
    clash = suffixes.remove(docs.withColumnRenamed("shared", "SPANS"))
    assert clash.columns == ["doc_id", "n_bytes", "spans", "kept"] and clash.count() == len(rows)
