"""Near-duplicates among embeddings by lattice hashing.

A unit vector is projected on random directions, 8 at a time, and each 8 projections are decoded
to the nearest point of the E8 lattice, the densest packing of 8 dimensions. PARTS such points
name the vector's cell in a table, and there are TABLES tables. A vector is stored in its own
cell of each table and looks itself up there and in the PROBES cells next to it, those that it
lies closest to; whatever meets in a cell is compared by its cosine in double precision. The tests
measure which part of the pairs meet in some cell: in 64 dimensions 99 % of those of a cosine of
just 0.95, all but one in some thousand from 0.97 on, and 3 in 100,000 of unrelated ones.

Pairs are not expanded. Equal vectors are one class, and classes are compared. The vectors
of a crowded cell within half of the threshold's angle of the cell's centre are a core: any two
of them are linked, by the triangle inequality, so they are counted and not compared. What else
meets in a cell is cut into blocks, two blocks meet in a task, and the task gives back how many
links each vector has and as many links as connect them. A pair that meets in several cells
counts in the first of them. Components come from contracting links in tables.

Defined results: vectors that are null, empty or zero, or hold null or non-finite entries, are
linked with nothing, and vectors of different lengths are not linked with each other; rows that
share an id are vectors of their own and count as links of each other; a row without an id
counts as a link of others, and a component of such rows only has no id; an empty table gives no
rows; further columns are not carried.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.frames import rows_per_batch
from tillroll.llm.near import _runs_of, components
from tillroll.llm.words import mixed
from tillroll.session import staged

TABLES, PARTS, PROBES, SCALE = 8, 2, 8, 1.5
KEYS = PROBES + 1
BLOCK = 512
CROWDED = 256
ROWS_PER_BATCH = 1024
#: an angle by which a core stays inside the one that is proven
_MARGIN = 1e-6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps from a cell to those next to it."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = itertools.product((0.5, -0.5), repeat=8)
    return np.array(out + [v for v in halves if sum(x < 0 for x in v) % 2 == 0])


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Of each row the nearest point with whole coordinates of an even sum."""
    nearest = np.rint(x)
    error = x - nearest
    odd = np.flatnonzero(nearest.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    nearest[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return nearest


def decoded(x: np.ndarray) -> np.ndarray:
    """Of each row of 8 the nearest point of E8: one of two copies of the even points."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@cache
def directions(length: int) -> np.ndarray:
    rng = np.random.default_rng(20_260_213 + length)
    return rng.normal(size=(length, TABLES * PARTS * 8)) / SCALE


def _named(points: np.ndarray, table: int, part: int) -> np.ndarray:
    """A 64-bit value for lattice points (last axis of 8), of one part of one table."""
    value = np.full(points.shape[:-1], 1 + table * PARTS + part, np.uint64)
    doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
    for k in range(8):
        value = mixed(value * _ODD + doubled[..., k])
    return value


def cells(units: np.ndarray) -> np.ndarray:
    """Keys of unit vectors (rows), for each table the own cell and then those probed, nearest
    first; each probed one is next to the own cell in one part or in two."""
    projected = units @ directions(units.shape[1])
    out = np.empty((len(units), TABLES, KEYS), np.uint64)
    length = np.full(1, units.shape[1], np.uint64)
    for table in range(TABLES):
        names, costs = [], []
        for part in range(PARTS):
            begin = 8 * (table * PARTS + part)
            x = projected[:, begin : begin + 8]
            own = decoded(x)
            # what a step adds to the squared distance, less what all steps add
            nearer = (x - own) @ ROOTS.T
            best = np.argpartition(-nearer, PROBES, axis=1)[:, :PROBES]
            points = np.concatenate([own[:, None], own[:, None] + ROOTS[best]], axis=1)
            names.append(_named(points, table, part))
            steps = 2 - 2 * np.take_along_axis(nearer, best, axis=1)
            costs.append(np.concatenate([np.zeros((len(x), 1)), steps], axis=1))
        cost, name = costs[0], mixed(names[0] * _ODD + length)
        for more, other in zip(costs[1:], names[1:], strict=True):
            cost = (cost[:, :, None] + more[:, None, :]).reshape(len(units), -1)
            name = mixed(name[:, :, None] * _ODD + other[:, None, :]).reshape(len(units), -1)
        first = np.argsort(cost, axis=1, kind="stable")[:, :KEYS]
        out[:, table] = np.take_along_axis(name, first, axis=1)
    return out.reshape(len(units), -1).view(np.int64)


def units_of(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; largest entries first become 1, so that no square is lost."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _described(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id, length, and of comparable rows the vector's bytes and their digest."""

    def run(batches):
        for batch in batches:
            column, data, digests = batch["vector"], [], []
            for k in range(batch.num_rows):
                entries = column[k].values
                if entries is None or not len(entries) or entries.null_count:
                    found = None
                else:
                    found = entries.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
                    if not np.isfinite(found).all() or not found.any():
                        found = None
                data.append(None if found is None else found.tobytes())
                digests.append(
                    None if found is None else blake2b(data[-1], digest_size=16).digest()
                )
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(data, pa.binary()), pa.array(digests, pa.binary())],
                names=["vec_id", "vector", "digest"],
            )

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", F.col(f"`{vector}`").cast("array<double>").alias("vector")).mapInArrow(
        run, f"vec_id {kind}, vector binary, digest binary"
    )


def _matrix(column) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


def _by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, those with vectors of one length together."""
    for batch in batches:
        sizes = pc.binary_length(batch["vector"])
        for size in sizes.unique():
            yield batch.filter(pc.equal(sizes, size))


def _with_cells(classes: DataFrame) -> DataFrame:
    """Adds ``keys``, all cells of a class's vector; once, as they are read again."""

    def run(batches):
        for part in _by_length(batches):
            keys = cells(units_of(_matrix(part["vector"])))
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                names=[*part.schema.names, "keys"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{fields}, keys array<long>")


def _centres(members: DataFrame) -> DataFrame:
    """(key, centre): the sum of the unit vectors stored in each of some cells."""

    def run(batches):
        for batch in _by_length(batches):
            keys = batch["key"].to_numpy(zero_copy_only=False)
            names, which = np.unique(keys, return_inverse=True)
            units = units_of(_matrix(batch["vector"]))
            sums = np.zeros((len(names), units.shape[1]))
            np.add.at(sums, which, units)
            size = units.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(names, size)),
                    pa.array(np.tile(np.arange(size, dtype=np.int32), len(names))),
                    pa.array(sums.ravel()),
                ],
                names=["key", "at", "value"],
            )

    sums = members.mapInArrow(run, "key long, at int, value double")
    summed = sums.groupBy("key", "at").agg(F.sum("value").alias("value"))
    return summed.groupBy("key").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]
        ).alias("centre")
    )


def _cores(classes: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """(node, core): vectors so close to the centre of a crowded cell that any two are linked.

    Of several such cells the one that stores most counts, so that most of a group has one.
    """
    crowded = staged(
        keyed.where("stored")
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= CROWDED),
        "crowded",
    )
    if crowded.isEmpty():
        return classes.sparkSession.createDataFrame([], "node long, core long")
    vectors = classes.select("node", "vector")
    held = keyed.join(crowded, "key")
    centres = staged(
        _centres(held.where("stored").join(vectors, "node").select("key", "vector")), "centres"
    )
    nearest = math.cos(math.acos(percent / 100) / 2 - _MARGIN)

    def run(batches):
        for batch in _by_length(batches):
            units = units_of(_matrix(batch["vector"]))
            middle = batch["centre"].flatten().to_numpy(zero_copy_only=False)
            inside = (units * units_of(middle.reshape(units.shape))).sum(axis=1) >= nearest
            yield batch.select(["node", "key", "n"]).filter(pa.array(inside))

    inside = (
        held.join(vectors, "node")
        .join(centres, "key")
        .select("node", "key", "n", "vector", "centre")
        .mapInArrow(run, "node long, key long, n long")
    )
    return staged(
        inside.groupBy("node").agg(F.max_by("key", F.struct("n", "key")).alias("core")), "cores"
    )


def _share(hashed: Column, blocks: Column) -> Column:
    return F.pmod(hashed, blocks).cast("int")


def _blocked(members: DataFrame) -> DataFrame:
    """Members in every pair of blocks (low, high) they are compared in.

    The core that most of a cell's members share is apart from the rest: it is compared with the
    rest, block by block, but not within itself. Blocks of the core have numbers below 0.
    """
    by_core = members.where("core IS NOT NULL").groupBy("key", "core").agg(F.count("*").alias("c"))
    main = by_core.groupBy("key").agg(
        F.max_by("core", F.struct("c", "core")).alias("main"), F.max("c").alias("in_main")
    )
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    rest = F.col("n") - F.coalesce("in_main", F.lit(0))
    rows = (
        members.join(sizes, "key")
        .join(main, "key", "left")
        .where(rest > 0)
        .withColumns(
            {
                "apart": F.coalesce(F.col("core") == F.col("main"), F.lit(False)),
                "blocks": F.ceil(rest / BLOCK).cast("int"),
                "apart_blocks": F.ceil(F.coalesce("in_main", F.lit(0)) / BLOCK).cast("int"),
            }
        )
    )
    hashed = F.xxhash64("node")
    own = F.when(
        F.col("apart"), -1 - _share(hashed, F.greatest("apart_blocks", F.lit(1)))
    ).otherwise(_share(hashed, F.col("blocks")))
    none = F.array().cast("array<int>")
    others = F.concat(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        F.when(
            ~F.col("apart") & (F.col("apart_blocks") > 0),
            F.sequence(-F.col("apart_blocks"), F.lit(-1)),
        ).otherwise(none),
    )
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select(
            "key",
            "node",
            "stored",
            "core",
            "own",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
        )
    )


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of key lists (rows) the key of the first table in which they meet: the own
    cell of one that the other has or probes, the lower key if either probes the other's."""
    found = np.zeros(len(a), np.int64)
    open_ = np.ones(len(a), bool)
    for table in range(TABLES):
        x, y = (k[:, table * KEYS : (table + 1) * KEYS] for k in (a, b))
        in_y = (x[:, :1] == y).any(axis=1)  # a's cell, which b has or probes
        in_x = (y[:, :1] == x).any(axis=1)
        largest = np.iinfo(np.int64).max
        key = np.minimum(np.where(in_y, x[:, 0], largest), np.where(in_x, y[:, 0], largest))
        key = np.where(x[:, 0] == y[:, 0], x[:, 0], key)
        new = open_ & (in_x | in_y)
        found[new] = key[new]
        open_ &= ~new
    return found


_PAIRS_AT_ONCE = 1 << 14


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v, n): for each block pair how many vectors a vector is linked with (v null), and
    links that connect what is linked (n 0)."""

    def run(batches):
        for block in _runs_of(batches, ("key", "low", "high")):
            units = units_of(_matrix(block["vector"]))
            own, stored, core, node, copies = (
                block[c].to_numpy(zero_copy_only=False)
                for c in ("own", "stored", "core", "node", "copies")
            )
            within = block["low"][0].as_py() == block["high"][0].as_py()
            left = np.arange(len(own)) if within else np.flatnonzero(own == own[0])
            right = left if within else np.flatnonzero(own != own[0])
            if not len(right):
                continue
            near_by = units[left] @ units[right].T >= percent / 100
            near_by &= stored[left][:, None] | stored[right][None, :]
            if within:
                near_by = np.triu(near_by, 1)
            a, b = np.nonzero(near_by)
            a, b = left[a], right[b]
            # ones of the same core are counted already; 0 is no core
            other = (core[a] != core[b]) | (core[a] == 0)
            a, b = a[other], b[other]
            if not len(a):
                continue
            keys = np.stack([np.asarray(x) for x in block["keys"].to_pylist()])
            here = np.empty(len(a), bool)
            for start in range(0, len(a), _PAIRS_AT_ONCE):
                part = slice(start, start + _PAIRS_AT_ONCE)
                first = _first_meeting(keys[a[part]], keys[b[part]])
                here[part] = first == block["key"][0].as_py()
            a, b = a[here], b[here]
            counts = np.bincount(a, copies[b], len(own)) + np.bincount(b, copies[a], len(own))
            held = np.flatnonzero(counts)
            if not len(held):
                continue
            u, v = _spanning(a, b, len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[held], node[u]])),
                    pa.array([*[None] * len(held), *node[v].tolist()], pa.int64()),
                    pa.array(
                        np.concatenate([counts[held].astype(np.int64), np.zeros(len(u), np.int64)])
                    ),
                ],
                names=["u", "v", "n"],
            )

    columns = ("key", "low", "high", "own", "stored", "core", "node", "copies", "vector", "keys")
    dealt = rows.select(*columns).repartition("key", "low", "high")
    return dealt.sortWithinPartitions("key", "low", "high").mapInArrow(run, "u long, v long, n long")


def _spanning(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has a link, with the least one it is connected to by these links."""
    root = np.arange(count)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = np.flatnonzero(root != np.arange(count))
    return moved, root[moved]


def groups(vectors: DataFrame, percent: int = 95, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``; pairs of a cosine of
    ``percent`` / 100 or more are linked. The tables' cells fit 95 or more."""
    if not 95 <= percent <= 100:
        raise ValueError("percent must be from 95 to 100")
    with rows_per_batch(vectors.sparkSession, ROWS_PER_BATCH):
        described = staged(_described(vectors, vector), "described")
        merged = (
            described.where("digest IS NOT NULL")
            .groupBy("digest")
            .agg(
                F.min("vec_id").alias("vec_id"),
                F.count("*").alias("copies"),
                F.any_value("vector").alias("vector"),
            )
        )
        # numbers stay as the write fixes them
        numbered = staged(merged.withColumn("node", F.monotonically_increasing_id()), "numbered")
        classes = staged(_with_cells(numbered), "classes")
        keyed = classes.select("node", F.posexplode("keys").alias("at", "key")).select(
            "node", "key", (F.col("at") % KEYS == 0).alias("stored")
        )
        cores = _cores(classes, keyed, percent)
        shared = staged(
            keyed.groupBy("key")
            .agg(F.count("*").alias("n"), F.bool_or("stored").alias("held"))
            .where("n > 1 AND held")
            .select("key"),
            "shared",
        )
        members = staged(
            keyed.join(shared, "key").join(cores, "node", "left"), "members"
        )
        rows = _blocked(members).join(classes.select("node", "copies", "vector", "keys"), "node")
        compared = staged(
            _links(rows.withColumn("core", F.coalesce("core", F.lit(0))), percent), "compared"
        )
    sized = classes.join(cores, "node", "left")
    in_core = cores.join(classes.select("node", "copies"), "node").groupBy("core").agg(
        F.min("node").alias("least"), F.sum("copies").alias("all")
    )
    stars = cores.join(in_core, "core").select(F.col("node").alias("u"), F.col("least").alias("v"))
    found = components(compared.where("v IS NOT NULL").select("u", "v").unionByName(stars), "lattice")
    counts = compared.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("found"))
    labelled = staged(
        sized.select("node", "digest", "vec_id", "copies", "core")
        .join(counts.withColumnRenamed("u", "node"), "node", "left")
        .join(in_core.select("core", "all"), "core", "left")
        .join(found, "node", "left")
        .select(
            "digest",
            "vec_id",
            F.coalesce("component", "node").alias("component"),
            (
                F.coalesce("found", F.lit(0)) + F.coalesce("all", "copies") - 1
            ).cast("long").alias("n_links"),
        ),
        "labelled",
    )
    least = labelled.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    by_digest = labelled.join(least, "component").select("digest", "n_links", "component_id")
    kind = dict(described.dtypes)["vec_id"]
    return (
        described.drop("vector")
        .join(by_digest, "digest", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("digest").isNull(), F.col("vec_id"))
            .otherwise(F.col("component_id"))
            .cast(kind)
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
