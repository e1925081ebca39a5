import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tillroll.llm import licences
from tillroll.llm.registry import op6_licences

SF = "/root/testdata/sf0.01"
#: worded unlike the templates
HELD_OUT = {
    "apache": "this file is licensed under the apache license version 2.0 as stated there",
    "mit": "Our code is released under the MIT license!",
    "gpl": "licensed under the GNU general public license, version 2 or later",
    "mpl": "it is licensed under the Mozilla Public License, version 1.1",
    "proprietary": "(c) 1999 Somebody. ALL RIGHTS RESERVED",
}
PLAIN = ["the work was done by the version of them", "a license to kill", "on the under of public by", "free of charge"]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return licences.train(docs)


def test_notices_of_the_table_are_found_and_nothing_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    marks = {
        "Apache License": "apache", "MIT License": "mit", "GNU General": "gpl",
        "CC BY-NC": "cc-by-nc", "All rights reserved": "proprietary",
    }
    expected = {
        (d.doc_id, n, family)
        for d in docs
        for n, line in enumerate(d.text.split("\n"))
        for mark, family in marks.items()
        if mark in line
    }
    found = op6_licences(spark, SF).collect()
    named = {(r.doc_id, r.paragraph, r.family) for r in found if r.family != "unknown"}
    assert expected and len(named & expected) >= 0.98 * len(expected)
    assert len(named - expected) <= 0.02 * len(expected)
    assert len(found) - len(named) <= 0.01 * len(docs)


def test_held_out_wordings(spark, trained):
    rows = list(enumerate([*HELD_OUT.values(), *PLAIN]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.family for r in licences.scan(docs, *trained).collect()}
    right = sum(found.get(i) == family for i, family in enumerate(HELD_OUT))
    assert right >= 4, found
    assert all(found.get(len(HELD_OUT) + i, "unknown") == "unknown" for i in range(len(PLAIN)))


def words_by_hand(line):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", regex.sub(r"\p{N}+", "0", line.lower())) if w]


def pairs_by_hand(words):
    return set(zip(words, words[1:], strict=False))


def grams_by_hand(words):
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def scan_by_hand(spark, docs, model, least):
    """The decision on every paragraph in plain Python, from the coefficients and the templates."""
    hashing, fitted = model.stages
    weights, start = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    every = {
        g for d in docs for line in (d.text or "").split("\n") for g in grams_by_hand(words_by_hand(line))
    }
    rows = spark.createDataFrame([(g, [g]) for g in sorted(every)], "gram string, grams array<string>")
    place = {r.gram: int(r.features.indices[0]) for r in hashing.transform(rows).collect()}
    found = {}
    for doc in docs:
        for n, line in enumerate((doc.text or "").split("\n")):
            words = words_by_hand(line)
            if not words:
                continue
            raw = weights[:, sorted({place[g] for g in grams_by_hand(words)})].sum(axis=1) + start
            p = np.exp(raw - raw.max())
            p /= p.sum()
            best = int(np.argmax(p[:-1]))
            pairs = pairs_by_hand(words)
            alike = 0.0
            for template in licences.TEMPLATES[licences.FAMILIES[best]]:
                theirs = pairs_by_hand(words_by_hand(template))
                alike = max(alike, len(pairs & theirs) / max(1, min(len(pairs), len(theirs))))
            if p[-1] < 0.5 and alike >= licences.UNKNOWN_SIMILARITY:
                sure = p[best] >= least and alike >= licences.LEAST_SIMILARITY
                found[doc.doc_id, n] = (licences.FAMILIES[best] if sure else "unknown", p[best], alike)
    return found


def test_scan_matches_plain_python(spark, trained):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    cut = [" ".join(t.split()[:k]) for ts in licences.TEMPLATES.values() for t in ts for k in (2, 4, 9, 99)]
    mixed = [f"{a} and so on, {b}" for a, b in zip(cut, cut[5:], strict=False)]
    texts = [*HELD_OUT.values(), *PLAIN, "\n".join(cut), "\n\n".join(mixed), None, ""]
    more = [(10**9 + i, t) for i, t in enumerate(texts)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    expected = scan_by_hand(spark, docs.collect(), *trained)
    found = licences.scan(docs, *trained).collect()
    rows = {(r.doc_id, r.paragraph): (r.family, r.probability, r.similarity) for r in found}
    assert len(rows) == len(found) and rows.keys() == expected.keys()
    for key, (family, p, alike) in expected.items():
        assert rows[key][0] == family, key
        assert rows[key][1:] == pytest.approx((p, alike), abs=1e-9), key
    assert {"unknown", *licences.TEMPLATES} <= {family for family, _, _ in expected.values()}


def test_a_bound_that_binds_leaves_one_sample_and_one_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines = docs.count()
    many = "\n".join(f"line {'abcdefghij'[n % 10]} of {'klmnopqrst'[n // 10 % 10]} {n // 100 * 'x'}" for n in range(lines))
    docs = docs.unionByName(spark.createDataFrame([(10**9, many)], docs.schema))
    orders = [docs.repartition(7, "doc_id"), docs.orderBy(F.desc("doc_id")).coalesce(2)]
    every = {tuple(r.words) for r in licences.paragraphs(docs).select("words").distinct().collect()}
    assert len(every) > 300
    taken, models = [], []
    for rows in orders:
        taken.append(sorted(tuple(r.words) for r in licences.sample(rows, 10**6, 300).collect()))
        model, least = licences.train(rows, negative_documents=10**6, negative_paragraphs=300)
        models.append((model.stages[-1].coefficientMatrix.toArray().tobytes(), least))
    assert len(set(taken[0])) == len(taken[0]) == 300 and set(taken[0]) <= every
    assert taken[0] == taken[1] and models[0] == models[1]


def test_edge_cases(spark, trained):
    notice = "Released under the MIT License."
    long = "words of no licence " * 20_000 + "\n" + notice
    rows = [(None, None, "a"), (1, "", "b"), (None, notice, "c"), (2, long, "d"), (2, long, "d"), (3, "\n\n" + notice, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string")
    found = sorted((r.doc_id or 0, r.paragraph, r.family) for r in licences.scan(docs, *trained).collect())
    assert found == [(0, 0, "mit"), (2, 1, "mit"), (2, 1, "mit"), (3, 2, "mit")]
    assert licences.scan(docs.limit(0), *trained).count() == 0
    model, least = licences.train(docs.limit(0))
    assert licences.scan(docs, model, least).filter(F.col("family") == "mit").count() >= 1


def test_no_python_in_the_plan(spark, trained):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = licences.scan(docs, *trained)._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan and "MapInArrow" not in plan
