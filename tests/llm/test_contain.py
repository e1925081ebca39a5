import random
import re


from tillroll.llm import contain
from tillroll.llm.registry import op4_decontaminate

WORDS = re.compile(r"[^\W_]+")


def by_hand(docs, items, percent=80):
    def runs(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    out = {}
    for doc_id, text in docs:
        words, found = WORDS.findall((text or "").lower()), set()
        for item_id, item in items:
            own = WORDS.findall((item or "").lower())
            n = min(5, len(own))
            wanted = runs(own, n) if n else set()
            if wanted and 100 * len(wanted & runs(words, n)) >= percent * len(wanted):
                found.add(item_id)
        out[doc_id] = sorted(found)
    return out


def test_items_of_all_sizes_are_found_as_by_hand(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "it's", "x-y"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[5][1]), (5, "another text of item five")]
    docs = []
    for i in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:60])[1].split()
            for _ in range(rng.randint(0, 3)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    docs += [(300, None), (301, ""), (302, "ANOTHER text, of item FIVE!")]
    found = contain.find(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    expected = by_hand(docs, items)
    assert {r.doc_id: list(r.item_ids) for r in found} == expected
    assert sum(map(bool, expected.values())) > 60


def test_planted_passages_are_found_in_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = {r.doc_id: r for r in op4_decontaminate(spark, sf).collect()}
    planted = [(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text]
    assert planted
    for doc_id, item_id in planted:
        assert str(item_id) in found[doc_id].item_ids.split(",")


def test_edge_cases(spark):
    long = "filler " * 40_000 + "the exact words of one test item here " + "more " * 40_000
    rows = [(1, long, "a"), (1, long, "a"), (None, long, "b"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "the exact words of one test item here")], "item_id long, text string")
    out = contain.find(docs, items).collect()
    assert sorted(r.n_items for r in out) == [0, 1, 1, 1]
    assert contain.clean(docs, items).count() == 1
    assert contain.clean(docs, items).columns == docs.columns
    assert contain.find(docs.limit(0), items).count() == 0
    assert all(r.n_items == 0 for r in contain.find(docs, items.limit(0)).collect())
    clash = docs.withColumnRenamed("item_id", "digest")
    assert contain.find(clash, items).count() == 4
    assert contain.clean(clash, items).columns == clash.columns


def test_a_prompt_that_items_and_documents_share_makes_no_candidates(spark):
    rng = random.Random(11)
    prompt = "which of the following statements is true about the "
    vocabulary = [f"v{i}" for i in range(5000)]

    def some(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, prompt + some(rng.randint(4, 20))) for i in range(300)]
    docs = [(i, some(30) + " " + prompt + some(60)) for i in range(500)]
    docs += [(1000 + i, some(20) + " " + items[i][1] + " " + some(20)) for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = contain.find(table, benchmark).collect()
    assert {r.doc_id: list(r.item_ids) for r in found} == by_hand(docs, items)
    listed = contain._items(benchmark.selectExpr("md5(text) AS item", "text"), 80)
    wanted = contain._wanted(listed)
    runs = contain._runs(contain.SHINGLE)
    hits = table.select(
        contain.F.md5("text").alias("digest"), contain.words(contain.F.col("text")).alias("words")
    ).select("digest", contain.F.lit(1000).alias("size"), contain.F.explode(runs).alias("h"))
    # of 500 x 300 pairs that share shingles of the prompt
    assert contain._candidates(hits, wanted).count() <= 40
