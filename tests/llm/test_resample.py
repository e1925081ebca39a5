import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tillroll.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = "doc_id long, text string"


def lower(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def grams(text):
    words = WORD.findall(lower(text))
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % 10_000 for r in runs]


def by_hand(docs, target, percent=5, least=20):
    """Sorted (doc_id, n_features, weight, score, rank), each by its plain rule."""
    held = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, found in held:
        s.update(found)
    for text in target:
        t.update(grams(text)[1])
    whole, aim = sum(s.values()) + 10_000, sum(t.values()) + 10_000

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * aim)))

    rows = []
    for i, n, found in held:
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, weight + noise, None, n])
    able = [r for r in rows if r[5] >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[5]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def drawn(spark, docs, target, kinds=KINDS, **settings):
    found = resample.draw(
        spark.createDataFrame(docs, kinds),
        spark.createDataFrame([(x,) for x in target], "text string"),
        **settings,
    )
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def texts(count, seed=1):
    rng = random.Random(seed)
    words = ["Ärger", "the", "Cat", "42", "naïve", "x", "日本語", "of", "été", "B2B"] + [f"w{k}" for k in range(200)]
    gaps = [" ", "  ", ", ", "-", "\n", "\t", "_", " ", ".", "'", "\x00"]
    return [
        "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60, 200])))
        for _ in range(count)
    ]


def test_spans_are_all_runs_of_words():
    for text in ["", "a", "  A-b ", *texts(40)]:
        flat = resample.collapsed(text.encode())
        words = WORD.findall(lower(text))
        runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        assert [flat[a:b] for a, b in resample.spans(flat)] == runs


def test_as_by_hand(spark):
    docs = list(enumerate(texts(400)))
    target = texts(15, seed=2)
    assert drawn(spark, docs, target) == by_hand(docs, target)
    assert drawn(spark, docs, target, percent=30) == by_hand(docs, target, 30)


def test_draws_what_is_like_the_target(spark):
    rng = random.Random(4)
    kinds = [[f"{k}{n}" for n in range(300)] for k in ("alpha", "beta")]
    docs = [(k, " ".join(rng.choices(kinds[k % 10 == 0], k=60))) for k in range(1000)]
    found = drawn(spark, docs, [" ".join(rng.choices(kinds[1], k=60)) for _ in range(20)])
    chosen = [r[0] for r in found if r[4]]
    assert len(chosen) == 50 and all(i % 10 == 0 for i in chosen)


def test_defined_cases(spark):
    long = " ".join(["word%d" % (k % 7) for k in range(60_000)])
    same = texts(1, seed=9)[0] + " tie" * 25
    docs = [(1, None), (2, ""), (3, " ,.-"), (4, long), (5, same), (6, same), (None, same), (7, same), (7, same)]
    docs += [(k, same) for k in range(20, 60)]
    for target in ([], [None, ""], [same]):
        assert drawn(spark, docs, target, percent=50) == by_hand(docs, target, 50)
    assert drawn(spark, [], [same]) == []
    clashing = [(i, t, 7, "x") for i, t in docs]
    found = drawn(spark, clashing, [same], f"{KINDS}, rank int, Weight string", percent=50)
    assert found == by_hand(docs, [same], 50)


def test_resampled_documents(spark):
    docs = [(k, f"{t} w" * 25, k) for k, t in enumerate(texts(60))]
    df = spark.createDataFrame(docs, f"{KINDS}, Rank int")
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    ranks = {r.doc_id: r.rank for r in resample.draw(df, target, percent=20).collect() if r.rank}
    found = resample.resample(df, target, percent=20).collect()
    assert {r.doc_id: r.rank for r in found} == ranks and len(ranks) == 12
    assert all(r.text == docs[r.doc_id][1] for r in found)


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "score long, doc_id long").repartition(5)
    found = resample.ranked(df, df["score"].desc(), df["doc_id"].asc()).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.score, r.doc_id) for r in sorted(found, key=lambda r: r.rank)] == order
    assert [r.rank for r in sorted(found, key=lambda r: r.rank)] == list(range(1, 3001))


def test_gains_of_equal_shares_are_nothing():
    counts = np.arange(100)
    assert resample.gains(counts, counts).tolist() == [0] * 100
