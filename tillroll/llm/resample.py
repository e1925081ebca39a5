"""Importance resampling towards a target distribution, on hashed word n-grams.

A text is lower-cased (A-Z only) and every run of separators becomes a single space, so that a
run of n words is one match of a regular expression bounded by lookarounds. ``finditer`` with
``overlapped=True`` then gives the span of every such run, and the CRC-32 of the span's bytes,
modulo the number of buckets, is the feature's bucket. The ratio of a bucket's smoothed share
in the target to its share in the documents is its gain; a document's weight is the sum of its
features' gains. Adding Gumbel noise, drawn from the document's id, and taking the highest
scores draws without replacement in proportion to the weights.

Texts are scanned once: buckets are staged with the documents' ids, as sorted differences, and
read for the counts and again for the weights. What reaches the driver are the counts, as many
as there are buckets. Ranks come from a sort over ranges of (score, id) and the sizes of these
ranges; no task holds more than its range.

Defined results: a null text has no words and weight 0; documents with fewer than LEAST_WORDS
words get a score but are never drawn, nor do they count in the share that is; a null id hashes
as an empty one and comes last among ties; each of several rows of one id is judged by its own
text; without documents there are no rows, without a target all its counts are 0.
"""

from __future__ import annotations

import math
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.llm.frames import rows_per_batch, without
from tillroll.session import staged

LONGEST, BUCKETS, LEAST_WORDS = 3, 10_000, 20
#: separators to a space, A-Z to a-z
_FLAT = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def runs_pattern(n: int) -> regex.Pattern:
    """One match for each run of ``n`` words of a collapsed text, if matches may overlap."""
    return regex.compile(rb"(?<![^ ])" + b" ".join([b"[^ ]+"] * n) + rb"(?![^ ])")


def collapsed(text: bytes | None) -> bytes:
    """ASCII letters small, every run of separators a single space, none at the ends."""
    return b" ".join((text or b"").translate(_FLAT).split())


def spans(text: bytes, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Of a collapsed text, begin and end of all runs of 1 to ``longest`` words, by length."""
    return [
        m.span()
        for n in range(1, longest + 1)
        for m in runs_pattern(n).finditer(text, overlapped=True)
    ]


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the sorted buckets of every row of (doc_id, text),
    as differences of 32 bits."""

    def run(batches):
        patterns = [runs_pattern(n) for n in range(1, longest + 1)]
        whole = itemgetter(0)
        for batch in batches:
            words, sizes, found = [], [], []
            for data in batch["text"].to_pylist():
                text = collapsed(data)
                matches = (p.finditer(text, overlapped=True) for p in patterns)
                sums = [np.fromiter(map(crc32, map(whole, m)), np.uint32) for m in matches]
                words.append(len(sums[0]))
                hashed = np.sort(np.concatenate(sums) % np.uint32(buckets))
                sizes.append(len(hashed))
                found.append(np.diff(hashed, prepend=np.uint32(0)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(words, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.binary()),
                ],
                names=["doc_id", "n_words", "n_features", "buckets"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, buckets binary"
    )


def _read(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint32), dtype=np.int64)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch["buckets"].to_pylist():
                total += np.bincount(_read(data), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"]
        )

    counted = found.select("buckets").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of how much more common it is in the target,
    floored; every bucket counts one feature more than it has."""
    n = len(source)
    whole, aim = float(source.sum() + n), float(target.sum() + n)
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * whole / ((float(s) + 1) * aim)))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` with ``weight``, the sum of the gains, in place of the buckets."""

    def run(batches):
        for batch in batches:
            weights = [int(gain[_read(data)].sum()) for data in batch["buckets"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weights, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    kind = dict(found.dtypes)["doc_id"]
    return found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def noise(doc_id: Column, seed: int = 42) -> Column:
    """1000 times a Gumbel variable, floored, that the id decides."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    uniform = (h + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank``, 1 for the first row of all in this order.

    Rows are sorted over ranges of the order; a row's place within its range is fixed by the
    write, and the ranges before it are counted from one row each.
    """
    place = F.monotonically_increasing_id()
    ordered = staged(rows.orderBy(*order).withColumn("place", place), "ranked")
    at = ordered.withColumns(
        {
            "range": F.shiftright("place", 33),
            "within": F.col("place").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    sizes = at.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select(
        "range",
        F.coalesce(
            F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    # as many rows as the sort has ranges
    return (
        at.join(F.broadcast(before), "range")
        .withColumn("rank", F.col("before") + F.col("within") + 1)
        .drop("place", "range", "within", "before")
    )


def draw(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = 42,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    ``docs`` has doc_id and text, ``target`` text. Drawn are ``percent`` of the documents with
    ``least_words`` words or more, rounded down.
    """
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    with rows_per_batch(docs.sparkSession):
        found = staged(features(docs, longest, buckets), "features")
        wanted = features(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
        gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
        scored = staged(weighed(found, gain).withColumn("score", score), "scored")
    in_play = F.col("n_words") >= least_words
    drawn = F.floor(F.lit(percent) * F.lit(scored.where(in_play).count()) / 100)
    order = ranked(
        scored.where(in_play), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_words"
    ).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = scored.where(~in_play).withColumn("rank", F.lit(None).cast("long"))
    return order.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The drawn documents with all their columns, and ``score`` and ``rank`` in place of columns
    of these names. Where several rows have one id, all come with the best draw of theirs."""
    drawn = draw(docs, target, **settings).where("rank IS NOT NULL")
    best = drawn.groupBy("doc_id").agg(
        F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank")
    )
    ids = best.withColumnRenamed("doc_id", "_drawn")
    return (
        without(docs, "score", "rank", "_drawn")
        .join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")))
        .drop("_drawn")
    )
