import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import ordinal
from tillroll.llm.registry import RANKS

from test_contain import by_hand as items_in
from test_near import by_hand as near_groups
from test_suffixes import by_hand as repeats_in

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the result of every stage, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "suffix_repeats", "decontaminated", "encoded"
    ]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_quality_stage_rejects_toxic_and_keeps_clean(spark, stages):
    graded = ordinal.ratings(spark.read.parquet(f"{SF}/labels.parquet"))
    kept = texts(stages[0][1])
    rated = {r.doc_id: r.grade for r in graded.collect()}
    share = [np.mean([i in kept for i, g in rated.items() if g == k]) for k in (0, 1, 2)]
    assert share[2] > 0.97 and share[0] < 0.3 and share[1] < 0.2, share


def test_near_duplicate_stage(stages):
    before, after = map(texts, stages[1])
    groups = near_groups(list(before.items()), 5, 80)
    assert set(after) == {i for i, (_, component) in groups.items() if i == component}


def test_suffix_stage(stages):
    before, after = map(texts, stages[2])
    for i, data, mask in repeats_in(list(before.items())):
        at, left = 0, ""
        for char in data.decode():
            size = len(char.encode())
            left += "" if mask[at : at + size].all() else char
            at += size
        assert after[i] == left, i
    assert all(r.n_chars == len(r.text) for r in stages[2][1].collect())


def test_decontamination_stage(spark, stages):
    before, after = map(texts, stages[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {i for i, found in items_in(list(before.items()), items).items() if not found}


def test_encoding_stage(stages):
    with open(public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    before = texts(stages[4][0])
    for r in stages[4][1].collect():
        assert list(memoryview(bytes(r.ids)).cast("I")) == known.encode_ordinary(before[r.doc_id])


def test_run_gives_the_last_stage(spark, stages):
    ran = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert ran == {r.doc_id: r.ids_sha256 for r in stages[4][1].collect()}


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"long{i % 3001}" for i in range(30_000))
    rows = [
        (1, None, "a", 1), (2, "", "b", 2), (None, "some words here", "c", 3), (3, long, "d", 4),
        (3, long, "d", 4), (4, "good words are here for all of us", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, p_accept int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        got = {(r.doc_id, r.kept, r.p_accept) for r in after.collect()}
        assert got <= {(i, k, p) for i, _, k, p in rows}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter(F.col("n_tokens") == 0).count() == 2
