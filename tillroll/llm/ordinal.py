"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are grades 0..K-1. All grades share one weight vector over hashed features; ordered
thresholds cut its score: P(grade <= k) = sigmoid(threshold[k] - score). From these come the
expected grade and the tail probability P(grade >= accepted), which selects documents.

Features of a text: which words occur (lower case, outer punctuation removed), the share of
each word shape (letters, digits and runs collapsed) and the share of words that repeat the
one before. Weights are fitted by proximal Adagrad with an L1 penalty, so that words that
say nothing weigh nothing however long a text is.

Fitting reads a bounded sample: of each grade, the ``per_grade`` rated documents of the
smallest id hash, repeated texts once. Their weights restore the share of each grade among
all ratings. Everything else covers all rows.

Defined results: a null or empty text has no features and so the score of the intercept; a
rating of a document that is absent is ignored, of several ratings of one document the lowest
counts; without ratings, or with one grade only, every document is accepted at its highest
grade with probability 1. Extra columns are kept, but for those that have the name of an added
one: it replaces them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.frames import giving_back, small_batches, without

WORD_BITS, SHAPE_BITS = 18, 12
N_FEATURES = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 1
SHAPE_SCALE = 15.0
PER_GRADE = 4000
ACCEPTED_GRADE = 2
ROWS_AT_ONCE = 512
CACHED_WORDS = 50_000
_EDGES = re.compile(r"^\W+|\W+$")


def _shape(word: str) -> str:
    def letters(m: re.Match) -> str:
        part = m.group()
        return "a" if part.islower() else "A" if part.isupper() and len(part) > 1 else "Aa"

    text = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", letters, word))
    return re.sub(r"(.)\1+", r"\1\1", text)


class _Buckets(dict):
    """Word to the buckets of its letters and of its shape; emptied when full."""

    def __missing__(self, word: str) -> tuple[int, int]:
        core = _EDGES.sub("", word).lower()
        first = zlib.crc32(core.encode()) & ((1 << WORD_BITS) - 1) if core else -1
        second = zlib.crc32(_shape(word).encode()) & ((1 << SHAPE_BITS) - 1)
        found = first, (1 << WORD_BITS) + second
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_BUCKETS = _Buckets()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, each once, and their values."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    seen: set[int] = set()
    shapes: dict[int, int] = {}
    for word, n in Counter(words).items():
        first, second = _BUCKETS[word]
        if first >= 0:
            seen.add(first)
        shapes[second] = shapes.get(second, 0) + n
    scale = SHAPE_SCALE / len(words)
    repeats = sum(map(eq, words, words[1:]))
    index = np.fromiter(seen, np.int32, len(seen))
    index = np.concatenate([index, np.fromiter(shapes, np.int32, len(shapes)), [N_FEATURES - 1]])
    value = np.ones(len(index), np.float32)
    value[len(seen) : -1] = np.fromiter(shapes.values(), np.float32, len(shapes)) * scale
    value[-1] = repeats * scale
    return index.astype(np.int32), value


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and ordered thresholds; no thresholds if nothing could be learnt."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        index, value = features(text)
        return float(np.dot(self.weights[index], value))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a row for each score."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    grades: np.ndarray,
    row_weights: np.ndarray,
    n_grades: int,
    epochs: int = 16,
    least_steps: int = 1000,
    batch: int = 64,
    rate: float = 0.4,
    penalty: float = 1e-3,
    seed: int = 1,
) -> OrdinalModel:
    """Weights and thresholds by proximal Adagrad over the given rows."""
    weights = np.zeros(N_FEATURES, np.float64)
    history = np.full(N_FEATURES, 1e-3)
    share = np.cumsum(np.bincount(grades, row_weights, n_grades))[:-1] / row_weights.sum()
    share = np.clip(share, 1e-4, 1 - 1e-4)
    thresholds = np.log(share / (1 - share))
    cut_history = np.full(n_grades - 1, 1e-3)
    row_weights = row_weights / row_weights.mean()
    rng = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-least_steps * batch // len(rows)))):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            sizes = np.array([len(rows[i][0]) for i in chosen])
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            score = np.bincount(owner, weights[index] * value, len(chosen))
            cuts = np.concatenate([[-np.inf], thresholds, [np.inf]])
            y = grades[chosen]
            upper, lower = _sigmoid(cuts[y + 1] - score), _sigmoid(cuts[y] - score)
            inside = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / inside, lower * (1 - lower) / inside
            scale = row_weights[chosen] / len(chosen)
            by_row = (up - low) * scale
            gradient = np.bincount(index, value * by_row[owner], N_FEATURES)
            touched = np.unique(index)
            g = gradient[touched]
            history[touched] += g * g
            step = rate / np.sqrt(history[touched])
            moved = weights[touched] - step * g
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            cut_gradient = np.bincount(y, -up * scale, n_grades)[:-1]
            cut_gradient += np.bincount(y, low * scale, n_grades)[1:]
            cut_history += cut_gradient**2
            thresholds = thresholds - 0.3 * rate / np.sqrt(cut_history) * cut_gradient
            thresholds = np.maximum.accumulate(thresholds + 1e-6 * np.arange(n_grades - 1))
    return OrdinalModel(weights.astype(np.float32), thresholds)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grade of a rating: 0 toxic, 1 of low quality, 2 good; null if neither is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def ratings(labels: DataFrame) -> DataFrame:
    """One grade for each rated document: the lowest of its ratings."""
    graded = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return graded.dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(
    df: DataFrame,
    rated: DataFrame,
    n_grades: int = 3,
    per_grade: int = PER_GRADE,
    text: str = "text",
) -> OrdinalModel:
    """The model of a bounded sample: ``per_grade`` rated documents of each grade.

    ``rated`` has doc_id and grade. The sample's features, at most n_grades * per_grade rows,
    are gathered on the driver; texts are not.
    """
    small_batches(df.sparkSession)
    rated = rated.select("doc_id", "grade").persist()
    total = dict(rated.groupBy("grade").count().collect())
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = None
    for grade in range(n_grades):
        part = rated.filter(F.col("grade") == grade).orderBy(*order).limit(per_grade)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = df.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    schema = "grade int, buckets binary, amounts binary"

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["grade"].cast(pa.int32()),
                    pa.array([i.tobytes() for i, _ in found], pa.binary()),
                    pa.array([v.tobytes() for _, v in found], pa.binary()),
                ],
                names=["grade", "buckets", "amounts"],
            )

    # in one order, whatever the partitions: the fit depends on it
    got = sorted({tuple(r) for r in texts.mapInArrow(giving_back(run), schema).collect()})
    rated.unpersist()
    grades = np.array([g for g, _, _ in got], np.int64)
    counts = np.bincount(grades, minlength=n_grades) if len(grades) else np.zeros(n_grades)
    if (counts > 0).sum() < 2:
        return OrdinalModel(np.zeros(N_FEATURES, np.float32), np.empty(0))
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, i, v in got]
    share = np.array([total.get(g, 0) for g in range(n_grades)]) / np.maximum(counts, 1)
    return fit(rows, grades, share[grades], n_grades)


def classify(
    df: DataFrame, model: OrdinalModel, accepted_grade: int = ACCEPTED_GRADE, text: str = "text"
) -> DataFrame:
    """Add expected_grade, p_accept = P(grade >= accepted_grade), and accepted (p >= 1/2)."""
    added = {"expected_grade": T.DoubleType(), "p_accept": T.DoubleType()}
    small_batches(df.sparkSession)
    df = without(df, *added, "accepted")
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                tails = known.tails(np.array([known.score(t) for t in batch[text].to_pylist()]))
                if len(known.thresholds):
                    expected, accept = tails.sum(axis=1), tails[:, accepted_grade - 1]
                else:
                    expected = np.full(batch.num_rows, float(accepted_grade))
                    accept = np.ones(batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(expected), pa.array(accept)],
                    names=[*batch.schema.names, *added],
                )

    return df.mapInArrow(giving_back(run), schema).withColumn("accepted", F.col("p_accept") >= 0.5)
