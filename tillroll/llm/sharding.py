"""Shards of near equal size by sampled splitters. DataFrame operations only.

Records are ordered by a key (group key, then id). A size-weighted sample of keys gives
quantile boundaries; records are range-partitioned by them, and ranges that turn out
overfull are subdivided by boundaries sampled from them alone. Sizes summed over whole
ranges, then inside each range, give every record its place in the total, and the place
gives the shard. The sample decides only how the work is divided: the result depends on
the records alone.

A group (equal group key) stays in one shard while its size is within ``tolerance`` of a
shard's share; a larger one is divided between records, by id.

Defined results: null keys and texts count as empty ones, null ids come first; repeated rows
each get a slot; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillroll.session import staged

ROWS_PER_RANGE = 250_000
SAMPLES_PER_RANGE = 32
LEAST_RANGES = 256
TOLERANCE = 0.005
SUBDIVISIONS = 4
_HEX = 3  # leading digits of the group key that name a cell of the boundary table
_FIRST = -(2**63)


def _uniform(*columns: str) -> Column:
    """A number in [0, 1) drawn from the key alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 53)) / float(1 << 53)


def _boundaries(keys: list[tuple[str, int]], step: int) -> list[tuple[str, int]]:
    """Every ``step``-th key; the first of each group is moved to the group's begin."""
    out: list[tuple[str, int]] = []
    for group, row in sorted(keys)[step::step]:
        begin = (group, _FIRST)
        if not out or out[-1][0] != group:
            out.append(begin)
        elif (group, row) != out[-1]:
            out.append((group, row))
    return out


def _lookup(spark: SparkSession, bounds: list[tuple[str, int]]) -> DataFrame:
    """Boundaries by cell: how many lie before the cell, and its own in blocks of a square
    root of their number. One row for each of 16 ** _HEX cells, and all boundaries."""
    cells: dict[str, list] = {}
    for bound in bounds:
        cells.setdefault(bound[0][:_HEX], []).append(bound)
    rows, before = [], 0
    for number in range(16**_HEX):
        cell = f"{number:0{_HEX}x}"
        own = cells.get(cell, [])
        width = max(1, int(len(own) ** 0.5))
        blocks = [own[i : i + width] for i in range(0, len(own), width)]
        rows.append((cell, before, width, [b[0] for b in blocks], blocks))
        before += len(own)
    bound = "struct<g:string,i:bigint>"
    return spark.createDataFrame(
        rows,
        f"cell string, before int, width int, heads array<{bound}>, blocks array<array<{bound}>>",
    )


def _ranged(keyed: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """Add the number of boundaries at or below each record's key, as ``range_id``."""
    lookup = _lookup(keyed.sparkSession, bounds)
    key = F.struct(F.col("g").alias("g"), F.coalesce("i", F.lit(_FIRST)).alias("i"))
    below = F.size(F.filter("heads", lambda b: b <= key))
    inside = F.size(F.filter(F.element_at("blocks", F.col("full")), lambda b: b <= key))
    return (
        keyed.withColumn("cell", F.substring("g", 1, _HEX))
        .join(F.broadcast(lookup), "cell")
        .withColumn("full", below)
        .withColumn(
            "range_id",
            F.when(F.col("full") == 0, F.col("before")).otherwise(
                F.col("before") + (F.col("full") - 1) * F.col("width") + inside
            ),
        )
        .drop("cell", "before", "width", "heads", "blocks", "full")
    )


def _stats(ranged: DataFrame) -> DataFrame:
    """Bytes and records of each range; one row for each range comes to the driver."""
    return ranged.groupBy("range_id").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )


def _sample(keyed: DataFrame, rate: Column) -> list[tuple[str, int]]:
    chosen = keyed.filter(_uniform("g", "i") < rate)
    keys = chosen.select("g", F.coalesce("i", F.lit(_FIRST)).alias("i"))
    return [(r.g, r.i) for r in keys.collect()]


def assign(
    keyed: DataFrame,
    shards: int,
    tolerance: float = TOLERANCE,
    rows_per_range: int = ROWS_PER_RANGE,
    least_ranges: int = LEAST_RANGES,
) -> DataFrame:
    """Add ``shard`` and ``slot`` to records with g (lower-case hex), i (id) and size (long).

    The sample gathered on the driver has about SAMPLES_PER_RANGE keys for each range of
    ``rows_per_range`` records.
    """
    spark = keyed.sparkSession
    keyed = staged(keyed, "keyed")
    total, n = keyed.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return keyed.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    ranges = max(least_ranges, -(-n // rows_per_range))
    weighted = F.col("size") * F.lit(float(ranges * SAMPLES_PER_RANGE)) / F.lit(float(total))
    bounds = _boundaries(_sample(keyed, weighted), SAMPLES_PER_RANGE)

    limit = 2 * max(1, n // ranges)
    for _ in range(SUBDIVISIONS):
        ranged = _ranged(keyed, bounds)
        stats = {r.range_id: (r.bytes, r.rows) for r in _stats(ranged).collect()}
        overfull = {k: rows for k, (_, rows) in stats.items() if rows > limit}
        if not overfull:
            break
        rates = spark.createDataFrame(
            [(k, min(1.0, 2.0 * SAMPLES_PER_RANGE / limit)) for k in overfull],
            "range_id int, rate double",
        )
        inside = ranged.join(F.broadcast(rates), "range_id")
        more = _boundaries(_sample(inside, F.col("rate")), SAMPLES_PER_RANGE)
        merged = sorted({*bounds, *more, *((g, _FIRST) for g, _ in more)})
        if merged == bounds:
            break
        bounds = merged
    else:
        ranged = _ranged(keyed, bounds)
        stats = {r.range_id: (r.bytes, r.rows) for r in _stats(ranged).collect()}

    offsets, bytes_before, rows_before = [], 0, 0
    for k in range(len(bounds) + 1):
        offsets.append((k, bytes_before, rows_before))
        size, rows = stats.get(k, (0, 0))
        bytes_before, rows_before = bytes_before + size, rows_before + rows
    # groups that a boundary cuts begin at a boundary; their size is summed apart
    cut = {g for g, i in bounds if i != _FIRST}
    begins = [(g, offsets[k + 1][1]) for k, (g, i) in enumerate(bounds) if i == _FIRST and g in cut]
    cut_groups = F.broadcast(spark.createDataFrame(begins, "g string, cut_begin long"))
    cut_sizes = (
        keyed.join(cut_groups, "g").groupBy("g", "cut_begin").agg(F.sum("size").alias("cut_size"))
    )

    order = W.partitionBy("range_id").orderBy("g", F.col("i").asc_nulls_first())
    group = W.partitionBy("range_id", "g")
    running = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    offsets = spark.createDataFrame(offsets, "range_id int, bytes_before long, rows_before long")
    placed = (
        ranged.join(F.broadcast(offsets), "range_id")
        .withColumn("begin", F.col("bytes_before") + running - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.row_number().over(order) - 1)
        .withColumn("group_size", F.sum("size").over(group))
        .withColumn("group_begin", F.min("begin").over(group))
        .join(F.broadcast(cut_sizes), "g", "left")
        .withColumn("group_size", F.coalesce("cut_size", "group_size"))
        .withColumn("group_begin", F.coalesce("cut_begin", "group_begin"))
    )
    in_one_shard = F.col("group_size") <= int(tolerance * total / shards)
    middle = F.when(in_one_shard, 2 * F.col("group_begin") + F.col("group_size")).otherwise(
        2 * F.col("begin") + F.col("size")
    )
    placed = placed.withColumn("middle", middle * shards).withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(f"int(middle div {2 * total}L)"))
    )
    placed = staged(placed.select(*keyed.columns, "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("row") - F.col("first_row"))
        .drop("row", "first_row")
    )


def shard_documents(
    docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, text: str = "text"
) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, shard and slot of each document;
    equal texts are a group."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col("doc_id").alias("i"),
        F.md5(data).alias("g"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    return assign(keyed, shards, tolerance).select(
        F.col("i").alias("doc_id"), "size", "text_crc32", "shard", "slot"
    )
