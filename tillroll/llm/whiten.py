"""Whitening of embeddings from an exact covariance, summed over bit slices.

Entries become whole numbers of 1024ths. A dimension's numbers, less its least one, are cut
into bit planes, and the planes of a block of rows are packed into 64-bit words. The number of
rows in which two planes both have a bit is a population count of the words' AND; weighted by
powers of two these counts add up to the exact sum of products of every two dimensions. All
sums are whole numbers until the covariance, ``n * sum(xy) - sum(x) * sum(y)`` over ``n * n``,
is divided once, so it depends neither on the order of the rows nor on how they are dealt out.

Every task adds up its blocks and gives back a few rows for each pair of dimensions, whatever
the number of its vectors. What reaches the driver are these sums, as many as there are pairs.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out,
and so are those whose length is not the most common one (of equally common ones the larger);
numbers beyond 2 ** 61 are taken as that; a dimension that never changes has no share in any
component; directions without variance (to double precision) have no component; a deviation
that no 64-bit number holds is null in ``deviation``, and one that no decimal(38,0) holds in
``deviation_exact``; rows that share an id, and rows without one, are kept apart; with one row,
or none, there are no components and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.frames import rows_per_batch
from tillroll.session import staged

COMPONENTS = 8
STEP, OFFSET, LARGEST = 1024.0, 100_000, 2.0**61
BLOCK_ENTRIES = 1 << 18
_LIMB = 31
ROWS_PER_BATCH = 4096
COLUMNS = (
    "vec_id {}, component int, n long, deviation long, deviation_exact decimal(38,0), "
    "whitened double, explained double, identity_error double"
)


@dataclass
class Whitening:
    """``n`` vectors with least numbers ``low`` and sums ``sums`` (of numbers less ``low``), the
    components as rows, by falling eigenvalue, and the trace of the covariance."""

    n: int
    low: list[int]
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def length(self) -> int:
        return len(self.low)


def numbers(entries: np.ndarray) -> np.ndarray:
    """Whole 1024ths of entries, rounded down, plus OFFSET."""
    with np.errstate(over="ignore"):
        steps = np.floor(entries * STEP)
    return np.clip(steps, -LARGEST, LARGEST).astype(np.int64) + OFFSET


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows whose vector is there, not empty and finite throughout."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(
        "vector",
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))),
    )
    rows = vectors.select("vec_id", entries.alias("vector"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _extents(rows: DataFrame) -> DataFrame:
    """n, low and high of every dimension of every length."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            sizes = batch["vector"].value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                x = numbers(_matrix(part, size))
                own = [len(x), x.min(axis=0), x.max(axis=0)]
                if size in held:
                    n, low, high = held[size]
                    own = [n + own[0], np.minimum(low, own[1]), np.maximum(high, own[2])]
                held[size] = own
        for size, (n, low, high) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, size, np.int32)),
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.array(np.full(size, n, np.int64)),
                    pa.array(low),
                    pa.array(high),
                ],
                names=["length", "dimension", "n", "low", "high"],
            )

    return (
        rows.select("vector")
        .mapInArrow(run, "length int, dimension int, n long, low long, high long")
        .groupBy("length", "dimension")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    )


def bit_planes(shifted: np.ndarray, widths: list[int]) -> np.ndarray:
    """The bits of each column, lowest first, over all rows: one row of words for each bit."""
    rows = -(-len(shifted) // 64) * 64
    planes = []
    for d, width in enumerate(widths):
        column = shifted[:, d].astype(np.uint64)
        bits = (column[None, :] >> np.arange(width, dtype=np.uint64)[:, None]) & np.uint64(1)
        padded = np.zeros((width, rows), np.uint8)
        padded[:, : len(shifted)] = bits
        planes.append(np.packbits(padded, axis=1))
    return np.ascontiguousarray(np.concatenate(planes)).view(np.uint64)


def scatter(shifted: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the columns, and of the products of every two (upper triangle), of numbers
    from 0 to 2 ** width - 1, as Python integers."""
    size = len(widths)
    sums, products = np.zeros(size, object), np.zeros((size, size), object)
    held = [d for d in range(size) if widths[d]]
    if not held:
        return sums, products
    planes = bit_planes(shifted, widths)
    starts = np.cumsum([0, *[widths[d] for d in held]])
    # sums of products stay below rows * 2 ** (two widths)
    fits = 2 * max(widths) + len(shifted).bit_length() < 62
    powers = np.array([1 << b for d in held for b in range(widths[d])], np.int64 if fits else object)
    alone = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    sums[held] = np.add.reduceat(alone * powers, starts[:-1])
    for k, d in enumerate(held):
        begin, end = starts[k], starts[k + 1]
        total = 0
        for b in range(begin, end):
            both = np.bitwise_count(planes[b] & planes[begin:]).sum(axis=1, dtype=np.int64)
            weighted = np.add.reduceat(both * powers[begin:], starts[k:-1] - begin)
            total = total + weighted * powers[b]
        products[d, held[k:]] = total
    return sums, products


def _sums(rows: DataFrame, low: list[int], widths: list[int]) -> tuple[list[int], list[list[int]]]:
    """Sums and sums of products over all rows of numbers less ``low``."""
    size = len(low)

    def run(batches):
        sums, products = np.zeros(size, object), np.zeros((size, size), object)
        floor, step = np.array(low, np.int64), max(64, BLOCK_ENTRIES // size)
        for batch in batches:
            shifted = numbers(_matrix(batch, size)) - floor
            for start in range(0, len(shifted), step):
                own = scatter(shifted[start : start + step], widths)
                sums, products = sums + own[0], products + own[1]
        pairs, limbs, values = [], [], []
        # of dimension d alone: pair -1 - d
        whole = [(-1 - d, s) for d, s in enumerate(sums.tolist())]
        whole += [(d * size + e, products[d, e]) for d in range(size) for e in range(d, size)]
        for pair, value in whole:
            limb = 0
            while value:
                pairs.append(pair)
                limbs.append(limb)
                values.append(value & ((1 << _LIMB) - 1))
                value >>= _LIMB
                limb += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs, pa.int64()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())],
            names=["pair", "limb", "value"],
        )

    found = (
        rows.select("vector")
        .mapInArrow(run, "pair long, limb int, value long")
        .groupBy("pair", "limb")
        .agg(F.sum("value").alias("value"))
    )
    sums, products = [0] * size, [[0] * size for _ in range(size)]
    for row in found.collect():
        part = row["value"] << (_LIMB * row["limb"])
        if row["pair"] < 0:
            sums[-1 - row["pair"]] += part
        else:
            d, e = divmod(row["pair"], size)
            products[d][e] += part
            if d != e:
                products[e][d] += part
    return sums, products


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """Centred as whole numbers, then divided once: every entry is rounded once."""
    size = range(len(sums))
    return np.array([[(n * products[d][e] - sums[d] * sums[e]) / (n * n) for e in size] for d in size])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Of ``usable`` rows of the most common length; None without any."""
    extents = staged(_extents(rows), "extents")
    common = extents.where("dimension = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if common is None:
        return None
    length, n = common["length"], common["n"]
    own = extents.where(F.col("length") == length).orderBy("dimension").collect()
    low = [r["low"] for r in own]
    widths = [(r["high"] - r["low"]).bit_length() for r in own]
    sums, products = _sums(rows.where(F.size("vector") == length), low, widths)
    v = covariance(n, sums, products)
    values, columns = np.linalg.eigh(v)
    values, axes = values[::-1], columns.T[::-1]
    least = values[0] * length * np.finfo(float).eps if len(values) else 0.0
    count = min(components, int((values > max(least, 0.0)).sum()))
    axes = axes[:count]
    if count:  # either sign would do: the largest entry is positive
        largest = np.abs(axes).argmax(axis=1)
        axes = axes * np.sign(axes[np.arange(count), largest])[:, None]
    return Whitening(n, low, sums, axes, values[:count], float(np.trace(v)))


def _deviation(centred: np.ndarray) -> list[int]:
    """Exact sum of squares of every row."""
    largest = float(np.abs(centred).max(initial=0))
    if centred.dtype == object or centred.shape[1] * largest**2 >= 2.0**62:
        centred = centred.astype(object)
    return (centred * centred).sum(axis=1).tolist()


def scores(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, deviation_exact and the array ``whitened``, one entry a component."""
    size, n = model.length, model.n
    scaled = (model.components / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches):
        low, sums = np.array(model.low, np.int64), np.array(model.sums, object)
        for batch in batches:
            shifted = numbers(_matrix(batch, size)) - low
            bound = n * int(shifted.max(initial=0)) + int(max(sums))
            if bound < 1 << 62:
                centred = n * shifted - sums.astype(np.int64)
            else:
                centred = n * shifted.astype(object) - sums
            exact = _deviation(centred)
            white = (centred / n).astype(float) @ scaled
            offsets = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"],
                    pa.array([x if x < 1 << 63 else None for x in exact], pa.int64()),
                    pa.array(
                        [Decimal(x) if x < 10**38 else None for x in exact], pa.decimal128(38, 0)
                    ),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel())),
                ],
                names=["vec_id", "deviation", "deviation_exact", "whitened"],
            )

    kind = dict(rows.dtypes)["vec_id"]
    return rows.where(F.size("vector") == size).mapInArrow(
        run,
        f"vec_id {kind}, deviation long, deviation_exact decimal(38,0), whitened array<double>",
    )


def identity_error(scored: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    entry = [F.col("whitened")[k] for k in range(components)]
    off = [
        F.abs(F.covar_pop(entry[k], entry[m]) - F.lit(float(k == m))).alias(f"c{k}_{m}")
        for k in range(components)
        for m in range(k, components)
    ]
    return max(scored.agg(*off).first())


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding"
) -> DataFrame:
    """One row for each usable vector and component: the vector's score, and the shares and
    checks of the fit. Further columns are not carried."""
    spark = vectors.sparkSession
    rows = usable(vectors, vector)
    with rows_per_batch(spark, ROWS_PER_BATCH):
        model = fit(rows, components)
        if model is None or not len(model.eigenvalues):
            return spark.createDataFrame([], COLUMNS.format(dict(rows.dtypes)["vec_id"]))
        scored = staged(scores(rows, model), "whitened")
    error = identity_error(scored, len(model.eigenvalues))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    spread = scored.select(
        "vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened")
    )
    return spread.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "deviation_exact",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
