import random
import re
from collections import Counter

import numpy as np
import regex

from tillroll.llm import ordinal, rules
from tillroll.llm.registry import op8_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def check(docs, judged):
    found = {r.doc_id: r for r in judged.collect()}
    for doc in docs:
        row, expected = found[doc.doc_id], by_hand(doc.text)
        assert tuple(row[m] for m in rules.MEASURES) == expected, doc
        failed = expected[0] < 10 or 100 * expected[4] > 20 * expected[0]
        assert row.base_failed == failed and not (failed and row.kept)


def test_query_measures_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    check(docs, op8_rules(spark, "/root/testdata/sf0.01"))


def votes_by_hand(text):
    """2 good, 1 bad, 0 abstains, of every rule."""
    text = text or ""
    n, chars, symbols, dup, repeated = by_hand(text)
    joined = "".join(WORD.findall(text))
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    upper = len(regex.findall(r"\p{Lu}", text))
    marks = len(regex.sub(r"[\p{L}\p{N}]+", "", joined))
    shouts = text.count("!!")
    cases = (
        (n >= 30, n < 10),
        (100 * repeated <= 5 * n, 100 * repeated > 20 * n),
        (100 * symbols <= 2 * n, 100 * symbols > 10 * n),
        (10 * dup <= lines, 10 * dup > 3 * lines),
        (3 * n <= chars <= 9 * n, chars < 2 * n or chars > 14 * n),
        (100 * upper <= 15 * chars, 100 * upper > 30 * chars),
        (100 * marks <= 6 * chars, 100 * marks > 9 * chars),
        (shouts == 0, 100 * shouts > 5 * n),
    )
    return [1 if bad else 2 if good else 0 for good, bad in cases]


def test_votes_and_posteriors_match_a_row_by_row_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    votes = np.array([votes_by_hand(d.text) for d in docs])
    objections = (votes == 1).sum(axis=1)
    good = np.where(objections == 0, 0.9, 0.3**objections)
    said = np.stack([votes == v for v in range(3)]).astype(float)  # vote, document, rule
    for _ in range(50):
        of_good = (np.einsum("vdk,d->vk", said, good) + 1) / (good.sum() + 3)
        of_bad = (np.einsum("vdk,d->vk", said, 1 - good) + 1) / ((1 - good).sum() + 3)
        odds = np.einsum("vdk,vk->d", said, np.log(of_good) - np.log(of_bad))
        odds += np.log(good.sum() + 1) - np.log((1 - good).sum() + 1)
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    found = {r.doc_id: r for r in op8_rules(spark, "/root/testdata/sf0.01").collect()}
    for doc, p in zip(docs, good, strict=True):
        row = found[doc.doc_id]
        assert abs(row.p_good - p) < 1e-6, doc
        assert row.kept == (not row.base_failed and p >= 0.5)
    assert 0 < np.mean(good >= 0.5) < 1


def test_odd_texts(spark):
    rng = random.Random(8)
    pieces = ["a", "b", "c d e f g", "\n", " ", "\u00a0", "\x0b", "é|", "##", "\r\n", "\u2028", "x y z"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", " ", "w " * 30_000, "\n\n", "one two three four five", "1 2 3 4 5 1 2 3 4 5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs.collect(), rules.judge(docs))


def test_clean_documents_are_kept_and_junk_is_not(spark):
    sf = "/root/testdata/sf0.1"
    graded = ordinal.ratings(spark.read.parquet(f"{sf}/labels.parquet"))
    rows = op8_rules(spark, sf).join(graded, "doc_id").collect()
    good = [r.kept for r in rows if r.grade == 2 and not r.base_failed]
    junk = [r.kept for r in rows if r.grade == 1]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.2, (np.mean(good), np.mean(junk))


def test_expectation_maximisation_finds_the_accuracies():
    rng = random.Random(1)
    truth, counts = {}, Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        code = 0
        for accuracy, speaks in ((0.95, 0.9), (0.8, 0.8), (0.75, 1.0), (0.6, 0.5)):
            vote = 0
            if rng.random() < speaks:
                vote = 2 if (rng.random() < accuracy) == good else 1
            code = code * 3 + vote
        counts[code] += 1
        truth.setdefault(code, []).append(good)
    found = rules.posteriors(counts, 4)
    weight = sum(counts.values())
    error = sum(abs(found[c] - np.mean(truth[c])) * counts[c] for c in counts) / weight
    assert error < 0.08


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(None, None, "v"), (1, "a b c d e f g h i j k", "w"), (1, "a b c d e f g h i j k", "w")],
        "doc_id long, text string, votes2 string",
    )
    out = rules.judge(docs).collect()
    assert len(out) == 3 and [r.base_failed for r in out if r.doc_id is None] == [True]
    assert rules.judge(docs.limit(0)).count() == 0
    assert rules.judge(docs.withColumnRenamed("votes2", "N_Words")).count() == 3
