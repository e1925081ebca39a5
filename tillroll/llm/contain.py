"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame
operations only.

A document is contaminated by a test item if it holds at least ``percent`` of the item's
distinct shingles of SHINGLE words. Items are partitioned by size; an item of q shingles may
miss at most q - need of them, so its sketch is its q - need + 1 least shingles (a bottom-k
MinHash whose length follows the size class): a document that contains the item has one of them
at least, whatever the order. The order is by the number of items that have a shingle and then
by hash, so that the words of a prompt which many items open with are in no sketch while an
item has others. Documents too small for a class are not looked up in it. As an item is far
shorter than a document, a sketch of the document of fixed length would lose it; the documents'
side therefore keeps all shingles. Candidates, and no other pairs, are confirmed by counting the
item's shingles in the document exactly.

Words are runs of letters and digits, lower-cased. An item of fewer words than a shingle is
looked for as its whole word sequence; one without words is found nowhere.

The sketches are broadcast only while Spark sees that they are small; beyond that the lookup
is a shuffle join.

Defined results: a null or empty text holds nothing; equal texts have equal results, also in
repeated rows and rows without an id; repeated items count once for each id; an empty table of
documents gives no rows, an empty one of items finds nothing; ``find`` carries no further
columns, ``clean`` carries all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.session import staged

SHINGLE, PERCENT = 5, 80


def words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(split, "")


def _runs(n: int, column: str = "words") -> Column:
    """Hashes of all runs of n words; none if there are fewer."""
    return F.when(
        F.size(column) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(column) - n),
            lambda i: F.xxhash64(F.lit(n), *[F.get(column, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame, percent: int) -> DataFrame:
    """(item, shingles, length, q, need, size_class) of each item text that has words."""
    split = benchmark.select("item", words(F.col("text")).alias("words")).distinct()
    own = F.when(F.size("words") >= SHINGLE, _runs(SHINGLE))
    for n in range(1, SHINGLE):
        own = own.when(F.size("words") == n, _runs(n))
    sized = (
        split.filter(F.size("words") > 0)
        .select("item", F.array_distinct(own).alias("shingles"), F.size("words").alias("n"))
        .withColumn("q", F.size("shingles"))
        .withColumn("need", F.expr(f"int(({percent} * q + 99) div 100)"))
    )
    return sized.select(
        "item",
        "shingles",
        F.least("n", F.lit(SHINGLE)).alias("length"),
        "q",
        "need",
        F.floor(F.log2("q")).cast("int").alias("size_class"),
    )


def _wanted(items: DataFrame) -> DataFrame:
    """(size_class, item, need, h, in_sketch) of every shingle of every item."""
    each = items.select("size_class", "item", "q", "need", F.explode_outer("shingles").alias("h"))
    held = each.groupBy("h").agg(F.count("*").alias("held"))
    order = W.partitionBy("item").orderBy("held", F.xxhash64(F.lit("order"), "h"), "h")
    place = F.row_number().over(order)
    return each.join(held, "h").select(
        "size_class", "item", "need", "h", (place <= F.col("q") - F.col("need") + 1).alias("in_sketch")
    )


def _candidates(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, item, need) of texts that have a shingle of the item's sketch."""
    sketches = wanted.filter("in_sketch").select("item", "need", "h")
    met = hits.join(sketches, "h").filter("size >= need")
    return met.select("digest", "item", "need").distinct()


def search(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """(digest, item_ids) of the texts that hold an item, by the MD5 of the text.

    ``docs`` has text, ``benchmark`` item_id and text. The outer form of explode keeps the
    optimizer from adding a filter that splits the text anew for every shingle.
    """
    by_text = benchmark.select("item_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("item"))
    items = staged(_items(by_text.select("item", "text"), percent), "items")
    lengths = [r.length for r in items.select("length").distinct().orderBy("length").collect()]
    digest = F.md5(F.coalesce("text", F.lit("")))
    split = docs.select(digest.alias("digest"), words(F.col("text")).alias("words"))
    all_runs = [_runs(n) for n in lengths] or [F.array().cast("array<bigint>")]
    runs = split.select("digest", F.array_distinct(F.concat(*all_runs)).alias("runs"))
    sized = runs.select("digest", F.size("runs").alias("size"), F.explode_outer("runs").alias("h"))

    # the item shingles that each text holds, in one pass: (digest, size, h)
    wanted = staged(_wanted(items), "wanted")
    values = staged(wanted.groupBy("h").agg(F.min("need").alias("least")), "values")
    hits = sized.join(values, "h").filter("size >= least").select("digest", "size", "h").distinct()
    hits = staged(hits, "hits")

    looked_up = _candidates(hits, wanted).join(wanted.select("item", "h"), "item")
    confirmed = (
        looked_up.join(hits.select("digest", "h"), ["digest", "h"])
        .groupBy("digest", "item", "need")
        .agg(F.count("*").alias("held"))
        .filter("held >= need")
    )
    named = confirmed.join(by_text.select("item", "item_id").distinct(), "item")
    return named.groupBy("digest").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids")
    )


def find(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_items, item_ids (ascending) and contaminated of each document."""
    found = search(docs, benchmark, percent)
    digest = F.md5(F.coalesce("text", F.lit("")))
    none = F.array().cast("array<bigint>")
    return (
        docs.select("doc_id", digest.alias("digest"))
        .join(found, "digest", "left")
        .withColumn("item_ids", F.coalesce(F.col("item_ids").cast("array<bigint>"), none))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("contaminated", F.col("n_items") > 0)
        .drop("digest")
    )


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = search(docs, benchmark, percent).select("digest").alias("found")
    digest = F.md5(F.coalesce("d.text", F.lit("")))
    return docs.alias("d").join(found, digest == F.col("found.digest"), "left_anti")
