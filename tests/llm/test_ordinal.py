import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import ordinal
from tillroll.llm.registry import op2_quality

LARGEST = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGEST}/documents.parquet").select("doc_id", "text")
    rated = ordinal.ratings(spark.read.parquet(f"{LARGEST}/labels.parquet"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.train(docs, rated.filter(~held_out))
    known = set(r.text for r in docs.join(rated.filter(~held_out), "doc_id").collect())
    test = ordinal.classify(docs.join(rated.filter(held_out), "doc_id"), model).collect()
    test = [r for r in test if r.text not in known]
    share = {
        g: np.mean([r.accepted for r in test if r.grade == g]) for g in (0, 1, 2)
    }
    assert share[2] > 0.98 and share[0] < 0.15 and share[1] < 0.1, share
    mean = [np.mean([r.expected_grade for r in test if r.grade == g]) for g in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]


def test_thresholds_are_ordered_and_probabilities_add_up():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(400):
        g = int(rng.integers(0, 4))
        rows.append((np.array([10 + g, 100 + int(rng.integers(0, 50))], np.int32), np.ones(2, np.float32)))
        grades.append(g)
    model = ordinal.fit(rows, np.array(grades), np.ones(400), 4)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([-3.0, 0.0, 2.5]))
    assert (np.diff(tails, axis=1) <= 0).all() and (tails >= 0).all() and (tails <= 1).all()


def test_grades_and_several_ratings(spark):
    rows = [(1, 1, 1), (2, 0, 0), (3, 1, 0), (3, 0, 0), (4, None, None), (5, None, 1), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.grade for r in ordinal.ratings(labels).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 5: 0}


def test_edge_cases(spark):
    long = "good words " * 50_000
    rows = [(1, None, None), (2, "", "a"), (3, long, "b"), (3, long, "b"), (None, "bad", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = ordinal.train(docs, none)
    out = ordinal.classify(docs, model).collect()
    assert len(out) == 5 and all(r.accepted and r.p_accept == 1 for r in out)
    one = ordinal.train(docs, spark.createDataFrame([(1, 2), (3, 2), (77, 0)], none.schema))
    assert len(one.thresholds) == 0
    two = ordinal.train(docs, spark.createDataFrame([(2, 0), (3, 2)], none.schema))
    again = ordinal.classify(docs, two).collect()
    assert [r.p_accept for r in again if r.doc_id == 3][0] > 0.5
    assert ordinal.classify(docs.limit(0), two).count() == 0
    clash = ordinal.classify(docs.withColumnRenamed("grade", "P_Accept"), two)
    assert clash.columns == ["doc_id", "text", "expected_grade", "p_accept", "accepted"]
    assert clash.count() == 5


def test_query_rejects_toxic_and_keeps_clean(spark):
    labels = spark.read.parquet(f"{LARGEST}/labels.parquet")
    rated = op2_quality(spark, LARGEST).join(ordinal.ratings(labels), "doc_id").collect()
    by = {g: [r.accepted for r in rated if r.grade == g] for g in (0, 1, 2)}
    assert np.mean(by[2]) > 0.98 and np.mean(by[0]) < 0.1


def test_a_long_word_counts_whole():
    word = "ab" * 40
    assert ordinal._shape(word + "42") != ordinal._shape(word) != ordinal._shape(word + "ABc")
    assert len(ordinal._shape("a1" * 50_000)) == 100_000
