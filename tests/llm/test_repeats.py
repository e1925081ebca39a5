import hashlib
import random

import pytest

from tillroll.llm import chunks, repeats
from tillroll.llm.registry import op9_repeats, span_sum


def by_hand(rows, window=20):
    """{doc_id: (n_words, n_removed, kept)} for rows with distinct ids."""
    seen, split = {}, {i: (t or "").encode().split() for i, t in rows}
    gone = {i: [False] * len(w) for i, w in split.items()}
    for i in sorted(split):
        words = split[i]
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if seen.setdefault(key, (i, s)) != (i, s):
                gone[i][s : s + window] = [True] * window
    return {
        i: (len(w), sum(gone[i]), b" ".join(x for x, g in zip(w, gone[i]) if not g).decode())
        for i, w in split.items()
    }


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    expected = by_hand([(d.doc_id, d.text) for d in docs])
    found = op9_repeats(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs)
    for r in found:
        n, removed, kept = expected[r.doc_id]
        sha = hashlib.sha256(kept.encode()).hexdigest()
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, sha), r.doc_id
    assert sum(r.n_removed for r in found) > 1000


@pytest.mark.parametrize("chunk_bytes", [700, 2_000_000])
def test_passages_of_all_alignments(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    rng = random.Random(chunk_bytes)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "a b"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 70))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            p = rng.choice(passages)
            words[at:at] = p[rng.randint(0, 5) :]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(200 + i, "x " * rng.randint(18, 60)) for i in range(8)]
    rows += [(300 + i, rows[7][1]) for i in range(30)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = repeats.remove(docs).withColumn("n", span_sum("spans")).collect()
    expected = by_hand(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n, r.kept) == expected[r.doc_id], r.doc_id
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"l{i % 5000}" for i in range(40_000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, passage, "c"), (3, passage, "c"), (None, passage, "d"),
        (4, "x " + passage, "e"), (5, long, "f"), (6, "few words", "g"), (7, "few words", "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    found = repeats.remove(docs).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {
        "doc_id", "copies", "n_words", "spans", "kept"
    }
    kept = {(r.doc_id, r.copies): r.kept for r in found}
    assert kept[3, "c"] == passage and kept[None, "d"] == passage and kept[4, "e"] == "x"
    assert kept[1, "a"] == "" and kept[7, "h"] == "few words"
    assert len(kept[5, "f"].split()) == 5000
    assert repeats.remove(docs.limit(0)).count() == 0
    clash = repeats.remove(docs.withColumnRenamed("copies", "Kept"))
    assert clash.columns == ["doc_id", "n_words", "spans", "kept"] and clash.count() == len(rows)
