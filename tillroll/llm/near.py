"""Near-duplicate groups: MinHash with a multi-index Hamming join.

A document is the set of its distinct word shingles. Equal sets are one class, and classes are
what is compared. A class has a signature of SYMBOLS minima, of b = 16 bits each. Two classes
just similar enough differ in more than MOST_ERRORS symbols, and their link is missed, with
probability 1.3e-4 at a similarity of 0.80, 2.0e-5 at 0.82 and 6.3e-7 at 0.85 (binomial); less
the more similar they are. The signature is cut into CHUNKS chunks. By the pigeonhole principle two signatures
within MOST_ERRORS have a chunk with at most MOST_ERRORS // CHUNKS = 1 error, so each class
looks itself up under every chunk with each symbol left out in turn: no pair of signatures
within the distance is missed.

Candidates are not expanded to all pairs. Of buckets with the same members the one of the first
key counts, and a pair counts in the bucket of the first key that it shares. A bucket of at most
BLOCK members is compared in a task, which gives back only as many pairs as connect what lies
within the signature distance. What they connect are the groups inside which links can be; a
group, if its sets have at most BLOCK_BYTES, is confirmed in a task on the full sets in the same
way, again only with pairs that connect something new.

Larger buckets and groups are contracted first: cut into blocks, each of which meets some CENTERS
members of the whole chosen by hash. What these links leave outside the largest component of the
group, and only that, then meets the blocks of all members. No link between components is lost,
and a group of true copies costs about its size, not its square; members that are mostly apart
still cost up to the square. Components come from hooking nodes to their least neighbour and
contracting, in tables, until no link is left.

Defined results: a text without words (or null) has an empty set and is linked with nothing;
a document with fewer words than a shingle has its whole word sequence as one; rows without
an id are linked with nothing, have no component and are kept; each row is judged by its own
text; an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm import words as W
from tillroll.llm.frames import giving_back, small_batches
from tillroll.session import staged

SYMBOLS, CHUNKS, MOST_ERRORS = 64, 13, 25
BLOCK, BLOCK_BYTES, CENTERS = 512, 64_000_000, 64
_rng = np.random.default_rng(20_260_101)
_FACTORS = (_rng.integers(1, 2**32, SYMBOLS, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_OFFSETS = _rng.integers(0, 2**32, SYMBOLS, dtype=np.uint64).astype(np.uint32)[:, None]
_COLUMNS_AT_ONCE = 1 << 14
_BOUNDS = [SYMBOLS * k // CHUNKS for k in range(CHUNKS + 1)]
#: of each key: its chunk's symbols but one
_KEYS = [
    [s for s in range(_BOUNDS[c], _BOUNDS[c + 1]) if s != left_out]
    for c in range(CHUNKS)
    for left_out in range(_BOUNDS[c], _BOUNDS[c + 1])
]


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``n`` words, ASCII letters lower-cased."""
    found = W.hashed((text or "").encode().lower().split())
    if not len(found):
        return np.empty(0, np.uint64)
    return np.unique(W.rolling(found, min(n, len(found))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low 16 bits of the least value of the set under each of SYMBOLS functions."""
    low = (W.mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 2**32 - 1, np.uint32)
    for start in range(0, len(low), _COLUMNS_AT_ONCE):
        part = low[None, start : start + _COLUMNS_AT_ONCE] * _FACTORS + _OFFSETS
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        part ^= part >> np.uint32(12)
        least = np.minimum(least, part.min(axis=1))
    return least.astype(np.uint16)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature (a row) its keys, one for each chunk and symbol left out."""
    wide = signatures.astype(np.uint64)
    out = np.empty((len(wide), len(_KEYS)), np.uint64)
    for k, symbols in enumerate(_KEYS):
        value = np.full(len(wide), k + 1, np.uint64)
        for s in symbols:
            value = W.mixed(value * np.uint64(0x9E3779B97F4A7C15) + wide[:, s])
        out[:, k] = value
    # the last six bits name the key's place among the keys
    return ((out << np.uint64(6)) | np.arange(len(_KEYS), dtype=np.uint64)).view(np.int64)


def first_shared_key(unequal: np.ndarray) -> np.ndarray:
    """For rows that tell which symbols two signatures differ in: their first key in common."""
    by_chunk = np.add.reduceat(unequal, _BOUNDS[:-1], axis=1, dtype=np.int64)
    chunk = (by_chunk <= 1).argmax(axis=1)
    begin = np.array(_BOUNDS)[chunk]
    inside = np.arange(SYMBOLS)[None, :] >= begin[:, None]
    left_out = (unequal & inside).argmax(axis=1)
    one = by_chunk[np.arange(len(chunk)), chunk] == 1
    return np.where(one, left_out, begin)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest and signature of every row."""

    def run(batches):
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in batch["text"].to_pylist():
                found = shingles(text, n)
                sizes.append(len(found))
                digests.append(
                    blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                )
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        giving_back(run), "doc_id long, n_shingles long, set binary, signature binary"
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    data = b"".join(batch["signature"].to_pylist())
    return np.frombuffer(data, np.uint16).reshape(-1, SYMBOLS)


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, node): every class under all its keys."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                keys = bucket_keys(_matrix(batch))
                nodes = np.repeat(batch["node"].to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"]
                )

    return classes.select("node", "signature").mapInArrow(giving_back(run), "key long, node long")


def _parts(n: Column, size: Column) -> Column:
    """How many blocks n members with sets of that many bytes are cut into."""
    by_rows, by_bytes = F.ceil(n / BLOCK), F.least(n, F.ceil(size / BLOCK_BYTES))
    return F.greatest(by_rows, by_bytes).cast("int")


def _block(parts: Column, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _blocked(rows: DataFrame, group: str) -> DataFrame:
    """Members of a block pair (low, high) side by side; ``own`` tells the two sides apart,
    unless low and high are the same."""
    rows = rows.select(group, "low", "high", "own", "node", "root", "n_shingles", "signature", "set")
    return rows.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def _around_centers(rows: DataFrame, group: str) -> DataFrame:
    """Each block of a large group with the group's centers."""
    n = F.col("n")
    parts = _parts(n, F.col("bytes"))
    few = F.least(F.lit(CENTERS), F.greatest(F.lit(1), F.floor(BLOCK_BYTES * n / F.col("bytes"))))
    centers = rows.filter(_block(F.ceil(n / few).cast("int"), 1) == 0)
    members = rows.withColumn("low", _block(parts)).withColumn("own", F.lit(0))
    centers = centers.withColumn("low", _every(parts)).withColumn("own", F.lit(1))
    return members.unionByName(centers).withColumn("high", F.lit(-1))


def _outside(rows: DataFrame, group: str) -> DataFrame:
    """The groups of more than one ``root``: the root of most members, and how many members,
    with how many bytes, are outside it."""
    most = F.struct("n", "root")
    roots = rows.groupBy(group, "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    found = roots.groupBy(group).agg(
        F.max_by("root", most).alias("main"),
        (F.sum("n") - F.max("n")).alias("rest"),
        (F.sum("bytes") - F.max_by("bytes", most)).alias("rest_bytes"),
    )
    return found.filter("rest > 0")


def _still_apart(rows: DataFrame) -> DataFrame:
    """Blocks of what is outside the main root, each with the blocks of all members."""
    parts = _parts(F.col("n"), F.col("bytes"))
    rest_parts = _parts(F.col("rest"), F.col("rest_bytes"))
    members = rows.withColumn("low", _block(parts)).withColumn("high", _every(rest_parts))
    outside = rows.filter("root != main").withColumn("low", _every(parts))
    outside = outside.withColumn("high", _block(rest_parts, 2)).withColumn("own", F.lit(1))
    both = members.withColumn("own", F.lit(0)).unionByName(outside)
    return both.withColumn("high", -1 - F.col("high"))


def _linked(
    rows: DataFrame,
    sizes: DataFrame,
    group: str,
    percent: int,
    label: str,
    sets: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Links (u, v) that connect what is near, or what is linked by its sets, inside each group.

    ``rows`` have group, node, n_shingles, signature and size, the bytes that a member takes;
    ``sizes`` the n and bytes of each group; ``sets`` gives (node, set) of some nodes.
    """

    def whole(some: DataFrame) -> DataFrame:
        if sets is None:
            return some.withColumn("set", F.lit(None).cast("binary"))
        return some.join(sets(some.select("node").distinct()), "node")

    def compared(blocks: DataFrame, stars: bool = False) -> DataFrame:
        return _connected(_blocked(blocks, group), group, percent, sets is not None, stars)

    one = _parts(F.col("n"), F.col("bytes")) == 1
    small = whole(rows.join(sizes.filter(one), group).withColumn("root", F.col("node")))
    links = compared(small.select("*", *[F.lit(0).alias(c) for c in ("own", "low", "high")]))
    if sizes.filter(~one).isEmpty():
        return links
    large = staged(rows.join(sizes.filter(~one), group), f"{label}-large")
    alone = whole(large.withColumn("root", F.col("node")))
    stars = staged(compared(_around_centers(alone, group), True).distinct(), f"{label}-stars")
    roots = components(stars, f"{label}-roots").withColumnRenamed("component", "root")
    # a node is in at most one group for each of its keys: they are looked up once for all
    places = F.collect_list(F.struct(group, "n", "bytes")).alias("places")
    nodes = large.groupBy("node", "n_shingles", "signature", "size").agg(places)
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    large = nodes.select("node", "n_shingles", "signature", "size", "root", F.inline("places"))
    outside = staged(_outside(large, group), f"{label}-outside")
    others = compared(_still_apart(whole(large.join(outside, group))))
    return links.unionByName(stars).unionByName(others)


def _connected(rows: DataFrame, group: str, percent: int, confirm: bool, stars: bool) -> DataFrame:
    """Pairs (u, v) that connect the members of each block pair which may be linked, or which
    are, if ``confirm`` (full sets are then in column ``set``); at most one less than members.
    Members of one ``root`` are connected already. ``stars``: whichever key is a pair's first."""

    def run(batches):
        for block in _runs_of(batches, (group, "low", "high")):
            signatures = np.frombuffer(
                b"".join(block["signature"].to_pylist()), np.uint16
            ).reshape(-1, SYMBOLS)
            sizes = block["n_shingles"].to_numpy(zero_copy_only=False)
            own = block["own"].to_numpy(zero_copy_only=False)
            within = block["low"][0] == block["high"][0]
            bucket = block[group][0].as_py() & 63
            sets = [np.frombuffer(x, np.uint64) for x in block["set"].to_pylist()] if confirm else None
            _, root = np.unique(block["root"].to_numpy(zero_copy_only=False), return_inverse=True)
            found = []
            for a in range(len(sizes) - 1):
                later = np.arange(a + 1, len(sizes))
                later = later[root[later] != root[a]]
                if not within:
                    later = later[own[later] != own[a]]
                small, large = np.minimum(sizes[later], sizes[a]), np.maximum(sizes[later], sizes[a])
                later = later[100 * small >= percent * large]
                unequal = signatures[later] != signatures[a]
                errors = unequal.sum(axis=1)
                near_by = errors <= MOST_ERRORS
                if not confirm and not stars:  # each pair counts in one of the buckets that it shares
                    near_by[near_by] = first_shared_key(unequal[near_by]) == bucket
                later = later[near_by][np.argsort(errors[near_by], kind="stable")]
                while len(later):
                    b, later = later[0], later[1:]
                    if confirm:
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * both < percent * (sizes[a] + sizes[b] - both):
                            continue
                    found.append((a, b))
                    root[root == root[b]] = root[a]
                    later = later[root[later] != root[a]]
            if found:
                nodes = block["node"].to_numpy(zero_copy_only=False)
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"]
                )

    return rows.mapInArrow(giving_back(run), "u long, v long")


def _runs_of(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches, one table for each run of equal keys of two rows or more.

    A run stays in the slices it came in: joined, its sets can be too long for one column.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch[key].to_numpy(zero_copy_only=False)
            edge[1:] |= column[1:] != column[:-1]
            edge[0] |= bool(held) and column[0] != held[0][key][0].as_py()
        ends = [0, *np.nonzero(edge)[0].tolist(), batch.num_rows]
        for k, (start, end) in enumerate(zip(ends, ends[1:], strict=False)):
            if k:
                if sum(x.num_rows for x in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            if end > start:
                held.append(batch.slice(start, end - start))
    if sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held)


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of the nodes that links (u, v) have: the least node reachable.

    Each node hooks to the least of itself and its neighbours; hooks are followed to their
    ends, and links between ends make a smaller graph, on which the same is done until no link
    is left. At least half of the nodes go each time.
    """
    low, high = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    edges = staged(links.select(low, high).where("a != b").distinct(), f"{label}-links")
    levels = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        hooks = staged(
            ends.groupBy("node").agg(F.min("other").alias("least")).select(
                "node", F.least("node", "least").alias("up")
            ),
            label,
        )
        while True:
            next_up = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            followed = staged(
                hooks.join(next_up, "up").select(
                    "node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")
                ),
                label,
            )
            hooks = followed.select("node", "up")
            if followed.where("moved").isEmpty():
                break
        levels.append(hooks)
        between = edges.join(
            hooks.select(F.col("node").alias("a"), F.col("up").alias("u")), "a"
        ).join(hooks.select(F.col("node").alias("b"), F.col("up").alias("v")), "b")
        edges = staged(between.select(low, high).where("a != b").distinct(), f"{label}-links")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels.pop().withColumnRenamed("up", "component")
    while levels:
        above = found.select(F.col("node").alias("up"), F.col("component"))
        found = levels.pop().join(above, "up", "left").select(
            "node", F.coalesce("component", "up").alias("component")
        )
    return staged(found, label)


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; the
    signature length fits a percentage of 80 or more.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    small_batches(docs.sparkSession)
    described = staged(_described(docs, n), "described")
    classes = staged(
        described.filter("set is not null and doc_id is not null")
        .groupBy("set")
        .agg(
            F.min("doc_id").alias("node"),
            F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("signature").alias("signature"),
        ),
        "classes",
    )
    keyed = _buckets(classes)
    shared = staged(
        keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared"
    )
    members = staged(keyed.join(shared, "key").distinct(), "members")
    # buckets with the same members count once
    prints = members.groupBy("key", "n").agg(
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y"),
    )
    place = F.col("key").bitwiseAND(F.lit(63))
    chosen = prints.groupBy("n", "x", "y").agg(F.min_by("key", place).alias("key")).select("key", "n")
    described_nodes = classes.select("node", "n_shingles", "signature")
    buckets = staged(chosen.withColumn("bytes", F.col("n") * 2 * SYMBOLS), "buckets")
    rows = members.drop("n").join(described_nodes, "node").withColumn("size", F.lit(2 * SYMBOLS))
    near_by = staged(_linked(rows, buckets, "key", percent, "near").distinct(), "near-by")
    within = components(near_by, "groups").withColumnRenamed("component", "group")
    placed = staged(
        within.join(described_nodes, "node").withColumn("size", 8 * F.col("n_shingles")), "placed"
    )
    sizes = staged(
        placed.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "sizes"
    )

    def full(nodes: DataFrame) -> DataFrame:
        return _sets(docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id"), n)

    links = _linked(placed, sizes, "group", percent, "confirm", full)
    found = components(links)
    nodes = classes.select("set", "node").join(found, "node", "left").select(
        "set", F.coalesce("component", "node").alias("component")
    )
    return (
        described.drop("signature")
        .join(nodes, "set", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") == 0, F.col("doc_id"))
            .when(F.col("doc_id").isNotNull(), F.col("component"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, set): full shingle sets of the given rows, each once."""

    def run(batches):
        for batch in batches:
            found = [shingles(t, n).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(found, pa.binary())],
                names=["node", "set"],
            )

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "node long, set binary")
