"""Documents to clean, deduplicated, encoded training text, in five stages.

Each stage takes the rows that the one before kept, read again from the Parquet that they were
written to. A stage returns the columns of its input, whatever they are called; the last returns
the encoded documents. Null and empty texts pass every stage as empty ones; an empty table passes
as one. SQL can express neither the classifier nor the encoding: there is no ORACLE_SQL, and
tests compare the stages with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, contain, near, ordinal, suffixes
from tillroll.llm.frames import brought_back, set_aside
from tillroll.llm.registry import RANKS, table
from tillroll.session import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on ``labels``, accepts."""
    model = ordinal.train(docs.select("doc_id", "text"), ordinal.ratings(table(spark, sf_dir, "labels")))
    judged = ordinal.classify(set_aside(docs, "doc_id", "text"), model)
    return brought_back(judged.filter("accepted"), docs.columns, "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id; rows without an id stay."""
    groups = near.groups(docs, n=5, percent=80)
    by_id = groups.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return docs.join(by_id.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti")


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the characters that repeat a string of a smaller id; a character
    goes only with all its bytes. n_chars, where there is one, follows the text."""
    left = suffixes.remove(set_aside(docs, "doc_id", "text"), whole_characters=True)
    left = left.withColumn("text", F.col("kept").cast("string"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.char_length("text").cast(kind))
    return brought_back(left, docs.columns, "doc_id", "text", "n_chars")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of ``benchmark``."""
    return contain.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the bytes they decode to."""
    ranks = public_tokenizers.path(RANKS)
    # a small cache, and none left behind: the workers hold what the other stages need as well
    coded = bpe.encode(
        docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, cached_pieces=30_000, keep=False
    )
    decoded = bpe.decode(coded.drop("text"), ranks, keep=False)
    return decoded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_repeats", suffix_repeats),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
