"""Substring dedup by suffixes, sorted with a distributed merge sort that knows common prefixes.

Wanted are the bytes covered by a string of LENGTH bytes that also starts in a document of
smaller id. Not every suffix has to be sorted for that. Of every LENGTH consecutive bytes the
place with the least hash of its first ANCHOR bytes is an anchor; it depends on those bytes
alone, so equal strings have the same anchors in them.

1. Anchors whose ANCHOR bytes stand in one document only are dropped: chunks exchange sorted
   fingerprints and get back one bit each (as distributed string sorters do to find out which
   prefixes tell strings apart).
2. The suffixes at the others are sorted. A suffix is taken as the LENGTH bytes from the anchor
   and, to break ties, the LENGTH - ANCHOR bytes before it, read backwards: the context that
   holds every string of LENGTH bytes around the anchor. A chunk makes a sorted run of its
   distinct contexts and sends it front-coded (the length of the prefix shared with the one
   before, and the rest), cut at sampled splitters into ranges. A range merges its runs with a
   loser tree that keeps for every loser the prefix it shares with the last output, and so never
   compares known prefixes again.
3. In the merged order equal contexts are neighbours, and so are contexts of one anchor. Of
   equal contexts all but those of the smallest id are repeats in full. For the smallest, the
   strings around the anchor are looked up among the other contexts of the anchor. The answers go
   back to the chunks: one number for each context that was sent.

A context that a third of all documents hold is sent once by each chunk. An anchor may have any
number of contexts that differ, as a phrase does that many documents follow with other bytes. Such
an anchor is cut into several ranges, and with more than MOST_CONTEXTS in a range its strings are
not compared there: of each of its contexts the chunk of the smallest id sends the strings on, by
their 128-bit hashes, and gets one bit back for each.
Documents whose whole text a smaller id has too are settled by that alone.

Defined results: a null text is an empty one; rows without an id are kept whole and no source of
repeats; rows that share an id are no source for each other; extra columns are kept, but
for those that have the name of an added one; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import words as W
from tillroll.llm.chunks import (
    VALUES_PER_BUCKET,
    Chunk,
    bit_answers,
    bits_of,
    by_document,
    chunked,
    copies,
    covered,
    exchanged,
    filter_bits,
    finished,
    n_buckets,
    packed,
    received,
    result_schema,
    runs,
    sent_values,
    unpacked,
)
from tillroll.llm.frames import giving_back, without
from tillroll.llm.repeats import SPANS
from tillroll.session import staged

LENGTH, ANCHOR = 50, 32
LEFT = LENGTH - ANCHOR
CONTEXT = LENGTH + LEFT
VALUES_PER_CHUNK = 100_000
CONTEXTS_PER_RANGE = 100_000
CONTEXTS_PER_CHUNK = 16_000
MOST_CONTEXTS = 20_000
SAMPLED_CHUNKS, SAMPLES_PER_CHUNK = 64, 512
FULL, ASK = 2**32 - 1, 2**32 - 2
_BASE = 0x9E3779B1
_NO_HASH = np.uint32(2**32 - 1)
_BLOCK_BYTES = 128_000
_PAD = 0xFF  # never a byte of UTF-8


def _power(n: int) -> np.uint32:
    return np.uint32(pow(_BASE, n, 2**32))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the ANCHOR bytes from each place on, joined from halves."""
    power, span, left = data.astype(np.uint32) + np.uint32(1), 1, ANCHOR
    out, done = None, 0
    while left:
        if left & 1:
            if out is None:
                out, done = power, span
            else:
                n = len(power) - done
                out = out[:n] * _power(span) + power[done : done + n]
                done += span
        left >>= 1
        if left:
            n = len(power) - span
            power = power[:n] * _power(span) + power[span : span + n]
            span *= 2
    out = out ^ (out >> np.uint32(15))
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    out *= np.uint32(0x297A2D39)
    return out ^ (out >> np.uint32(15))


def _sliding(values: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values, span = take(values[:-span], values[span:]), span * 2
    return take(values[: span - width], values[width - span :]) if width > span else values


def _anchors_in(data: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of a string of LENGTH bytes around them; none that reach
    into padding."""
    hashes = _anchor_hashes(data)
    outside = np.concatenate([[0], np.cumsum(data == _PAD, dtype=np.int32)])
    hashes[outside[ANCHOR:] > outside[:-ANCHOR]] = _NO_HASH
    width = LENGTH - ANCHOR + 1
    least = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint32)
    greatest = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.nonzero((greatest == hashes) & (hashes != _NO_HASH))[0]


class _Anchors:
    """Places of anchors in the distinct long-enough documents of a chunk, joined with padding."""

    def __init__(self, chunk: Chunk, bits: int):
        self.places = [i for i in chunk.distinct() if len(chunk.texts[i]) >= LENGTH]
        self.ids = np.array([chunk.ids[i] for i in self.places], np.int64)
        pad = bytes([_PAD]) * LENGTH
        self.data = np.frombuffer(pad + b"".join(chunk.texts[i] + pad for i in self.places), np.uint8)
        self.sizes = np.array([len(chunk.texts[i]) for i in self.places], np.int64)
        self.begins = np.cumsum(self.sizes + LENGTH) - self.sizes
        # some documents at a time, so that the arrays stay in the processor's cache
        found, k = [np.empty(0, np.int64)], 0
        while k < len(self.places):
            start = int(self.begins[k]) - LENGTH
            k = max(k + 1, int(np.searchsorted(self.begins, start + _BLOCK_BYTES)))
            end = int(self.begins[k - 1] + self.sizes[k - 1]) + LENGTH
            found.append(_anchors_in(self.data[start:end]) + start)
        self.at = np.concatenate(found)
        self.number = np.searchsorted(self.begins, self.at, "right") - 1
        drop = np.uint64(64 - bits)
        words = self.data[self.at[:, None] + np.arange(ANCHOR)].view(np.uint64)
        values = np.zeros(len(self.at), np.uint64)
        for k in range(words.shape[1]):
            values = W.mixed(values * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
        self.values, self.which, _ = W.distinct(values >> drop << drop)

    def several(self) -> np.ndarray:
        """Whether two documents here or more have each distinct value."""
        order = np.lexsort((self.number, self.which))
        which, number = self.which[order], self.number[order]
        out = np.zeros(len(self.values), bool)
        out[which[1:][(which[1:] == which[:-1]) & (number[1:] != number[:-1])]] = True
        return out


class _Run:
    """The sorted distinct contexts of a chunk's shared anchors, and which anchors have each."""

    def __init__(self, anchors: _Anchors, shared: np.ndarray, left_out: set[int]):
        keep = shared & ~np.isin(
            anchors.number, [k for k, i in enumerate(anchors.places) if i in left_out]
        )
        self.at, self.number = anchors.at[keep], anchors.number[keep]
        reach = np.concatenate([np.arange(LENGTH), -1 - np.arange(LEFT)]).astype(np.int32)
        rows = anchors.data[self.at.astype(np.int32)[:, None] + reach]
        # padding, and all beyond it, hides what lies outside the document
        place, size = self.at - anchors.begins[self.number], anchors.sizes[self.number]
        near_end = np.nonzero((place + LENGTH > size) | (place < LEFT))[0]
        where = place[near_end, None] + reach
        edge = rows[near_end]
        edge[(where < 0) | (where >= size[near_end, None])] = _PAD
        rows[near_end] = edge
        whole = rows.view(f"V{CONTEXT}").ravel()
        _, first, self.which = np.unique(whole, return_index=True, return_inverse=True)
        self.rows = rows[first]
        ids = anchors.ids[self.number]
        self.least = np.full(len(first), 2**63 - 1)
        np.minimum.at(self.least, self.which, ids)
        self.most = np.full(len(first), -(2**63))
        np.maximum.at(self.most, self.which, ids)
        self.ids = ids

    def strings(self) -> list[bytes]:
        data = self.rows.tobytes()
        return [data[k : k + CONTEXT] for k in range(0, len(data), CONTEXT)]

    def cuts(self, splitters: list[bytes]) -> list[tuple[int, int, int]]:
        """(range, start, end) of the run's parts between the splitters."""
        strings = self.strings()
        ends = [0, *[bisect_left(strings, s) for s in splitters], len(strings)]
        return [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]

    def sent(self, splitters: list[bytes]) -> Iterator[tuple[int, bytes]]:
        for k, a, b in self.cuts(splitters):
            yield k, packed(front_coded(self.rows[a:b]), self.least[a:b])

    def answers(self, splitters: list[bytes], answers: list[dict] | None) -> np.ndarray:
        out = np.zeros(len(self.rows), np.uint32)
        known = {x["bucket"]: x["data"] for x in answers or []}
        for k, a, b in self.cuts(splitters):
            out[a:b] = np.frombuffer(known[k], np.uint32)
        return out


class _Strings:
    """The distinct strings around the anchors of those contexts that the merge left open."""

    def __init__(self, run: _Run, answers: np.ndarray):
        self.open = np.nonzero(answers == ASK)[0]
        rows = run.rows[self.open]
        around = np.concatenate([rows[:, :LENGTH - 1:-1], rows[:, :LENGTH]], axis=1)
        self.least = run.least[self.open]
        hashes, self.context, self.before = [], [], []
        for before in range(LEFT + 1):
            strings = around[:, LEFT - before :][:, :LENGTH]
            inside = np.nonzero((strings[:, 0] != _PAD) & (strings[:, -1] != _PAD))[0]
            hashes.append(_wide_hashes(strings[inside]))
            self.context.append(inside)
            self.before.append(np.full(len(inside), before, np.uint32))
        self.context, self.before = np.concatenate(self.context), np.concatenate(self.before)
        high, low = np.concatenate(hashes, axis=1)
        order, starts, self.which = _equal(high, low)
        self.high, self.low = high[order][starts], low[order][starts]
        ids = self.least[self.context]
        self.smallest = np.minimum.reduceat(ids[order], starts) if len(order) else ids

    def sent(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        return sent_values(self.high, [self.low, self.smallest], buckets)

    def masks(self, elsewhere: np.ndarray) -> np.ndarray:
        """For each open context a bit for each string that a smaller id has."""
        repeated = elsewhere[self.which] | (self.least[self.context] > self.smallest[self.which])
        out = np.zeros(len(self.open), np.uint32)
        np.bitwise_or.at(out, self.context[repeated], np.uint32(1) << self.before[repeated])
        return out


def _wide_hashes(strings: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each string of LENGTH bytes."""
    padded = np.zeros((len(strings), -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = strings
    words = padded.view(np.uint64)
    out = np.zeros((2, len(strings)), np.uint64)
    out[1] = 0x632BE59BD9B4E019
    for k in range(words.shape[1]):
        out[0] = W.mixed(out[0] * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
        out[1] = W.mixed((out[1] ^ words[:, k]) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _equal(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the pairs, where distinct ones start in it, and which one each pair is."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order, np.nonzero(new)[0], which


def _smaller_elsewhere(data: list[bytes]) -> list[bytes]:
    """Whether another chunk sent a string with a smaller id."""
    sizes, (high, low, least) = received(data)
    order, starts, which = _equal(high, low)
    return bit_answers(sizes, least > np.minimum.reduceat(least[order], starts)[which])


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Lengths of the prefixes that sorted rows share with the row before, and the rests."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        shared[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return shared.tobytes(), rest.tobytes()


def decoded_run(shared: bytes, rest: bytes) -> Iterator[tuple[int, int]]:
    """(length of the prefix shared with the one before, the string as a number) in order."""
    previous, at = b"", 0
    for n in shared:
        step = CONTEXT - n
        previous = previous[:n] + rest[at : at + step]
        at += step
        yield n, int.from_bytes(previous)


def merged(sources: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
    """(shared prefix with the output before, string as a number, source) in sorted order.

    A loser tree: each inner node holds the source that lost there. ``shared[s]`` is the prefix
    that the head of source s shares with the last output that passed its node. Of two heads the
    one that shares more is less; only if they share the same are their bytes compared, once.
    """
    n = 1
    while n < max(2, len(sources)):
        n *= 2
    end = 1 << (8 * CONTEXT + 1)
    heads, shared = [end] * n, [-1] * n
    for s, source in enumerate(sources):
        for _, heads[s] in source:
            shared[s] = 0
            break
    losers = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a], heads[b]
        if x == y:
            if x != end:
                shared[b] = CONTEXT
            return a, b
        if x > y:
            a, b = b, a
        shared[b] = CONTEXT - ((x ^ y).bit_length() + 7) // 8
        return a, b

    level = list(range(n))
    while len(level) > 1:
        pairs = [play(*level[k : k + 2]) for k in range(0, len(level), 2)]
        losers[len(pairs) : 2 * len(pairs)] = [lost for _, lost in pairs]
        level = [won for won, _ in pairs]
    winner = level[0]
    while heads[winner] != end:
        yield shared[winner], heads[winner], winner
        for shared[winner], heads[winner] in sources[winner]:  # noqa: B007
            break
        else:
            heads[winner], shared[winner] = end, -1
        node = (winner + n) // 2
        while node:
            other = losers[node]
            s, t = shared[winner], shared[other]
            if s < t:
                losers[node], winner = winner, other
            elif s == t:
                won, lost = play(winner, other)
                losers[node], winner = lost, won
            node //= 2


def _masks(contexts: list[bytes], least: list[int]) -> list[int]:
    """For each context of an anchor a bit for each string of LENGTH bytes around the anchor,
    by how many bytes before it the string begins: whether a smaller id has it."""
    out = [0] * len(contexts)
    around = [c[LENGTH:][::-1] + c[:LENGTH] for c in contexts]  # LEFT bytes, then the suffix
    for before in range(LEFT + 1):
        start = LEFT - before
        best: dict[bytes, int] = {}
        strings = [x[start : start + LENGTH] for x in around]
        for s, i in zip(strings, least, strict=True):
            if best.get(s, i) >= i:
                best[s] = i
        for k, (s, i) in enumerate(zip(strings, least, strict=True)):
            if best[s] < i and s[0] != _PAD and s[-1] != _PAD:
                out[k] |= 1 << before
    return out


def _decided(data: list[bytes], cut: frozenset[bytes], most: int) -> list[bytes]:
    """Answers to each run: FULL where a smaller id elsewhere has the context, else a mask, or
    ASK where the anchor is one of those ``cut`` into ranges or has more than ``most`` contexts."""
    parts = [unpacked(x) for x in data]
    least = [p[1].tolist() for p in parts]
    replies = [np.zeros(len(x), np.uint32) for x in least]
    next_of = [0] * len(parts)
    contexts: list[bytes] = []
    smallest: list[int] = []
    senders: list[list[tuple[int, int]]] = []
    many = False

    def close() -> None:
        if many:
            masks = [ASK] * len(contexts)
        else:
            masks = _masks(contexts, smallest) if len(contexts) > 1 else [0]
        for mask, low, who in zip(masks, smallest, senders, strict=True):
            for run, k in who:
                replies[run][k] = FULL if least[run][k] > low else mask

    for shared, string, run in merged([decoded_run(*p[0]) for p in parts]):
        k = next_of[run]
        next_of[run] = k + 1
        i = least[run][k]
        if shared == CONTEXT:
            senders[-1].append((run, k))
            if i < smallest[-1]:
                smallest[-1] = i
            continue
        context = string.to_bytes(CONTEXT)
        if contexts and (shared < ANCHOR or len(contexts) == most):
            many = many or shared >= ANCHOR
            close()
            contexts, smallest, senders = [], [], []
        if shared < ANCHOR:
            many = context[:ANCHOR] in cut
        contexts.append(context)
        smallest.append(i)
        senders.append([(run, k)])
    if contexts:
        close()
    return [r.tobytes() for r in replies]


def _shared(data: list[bytes]) -> list[bytes]:
    """Fingerprints that two documents have or more."""
    sizes, (values, several) = received(data)
    order = np.argsort(values, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    starts = np.nonzero(new)[0]
    verdict = (np.diff(np.append(starts, len(order))) > 1) | np.logical_or.reduceat(several[order], starts)
    flat = np.empty(len(order), bool)
    flat[order] = verdict[np.cumsum(new) - 1]
    return bit_answers(sizes, flat)


def _intervals(run: _Run, anchors: _Anchors, answers: np.ndarray):
    """(document number, start, end) of the bytes that repeats around each anchor cover."""
    answer = answers[run.which]
    full = (answer == FULL) | (run.ids > run.least[run.which])
    begin = anchors.begins[run.number]
    place, size = run.at - begin, anchors.sizes[run.number]
    start = np.maximum(place - LEFT, 0)[full]
    end = (np.minimum(place, size - LENGTH) + LENGTH)[full]
    found = [(run.number[full], start, end)]
    part = np.nonzero(~full & (answer > 0))[0]
    for before in range(LEFT + 1):
        chosen = part[(answer[part] >> np.uint32(before)) & 1 > 0]
        found.append((run.number[chosen], place[chosen] - before, place[chosen] - before + LENGTH))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _cut(text: bytes, mask: np.ndarray | bool | None) -> tuple:
    n = len(text)
    if mask is True:
        mask = np.full(n, n >= LENGTH)
    if mask is None or not mask.any():
        return n, [], text
    kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
    return n, [{"start": a, "end": b} for a, b in runs(mask)], kept


def _cut_characters(text: bytes, mask: np.ndarray | bool | None) -> tuple:
    """As _cut, but a character goes only with all its bytes."""
    if mask is True:
        mask = np.full(len(text), len(text) >= LENGTH)
    if mask is not None and mask.any():
        data = np.frombuffer(text, np.uint8)
        which = np.cumsum((data & 0xC0) != 0x80) - 1
        some_kept = np.bincount(which, ~mask) > 0
        mask = ~some_kept[which]
    return _cut(text, mask)


def remove(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """Add n_bytes, spans (maximal removed runs of bytes) and kept (the other bytes) to ``docs``
    (doc_id, text and other columns); the text itself is not carried."""
    spark = docs.sparkSession
    docs = without(docs, "n_bytes", "spans", "kept")
    schema = result_schema(
        docs.drop("text"),
        [
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("kept", T.BinaryType()),
        ],
    )
    chunks = chunked(docs)
    buckets = n_buckets(chunks, VALUES_PER_CHUNK)
    bits = filter_bits(chunks, VALUES_PER_CHUNK)
    ranges = max(8, chunks.count() * CONTEXTS_PER_CHUNK // CONTEXTS_PER_RANGE)

    def fingerprints(row):
        anchors = _Anchors(Chunk(row["data"]), bits)
        return sent_values(anchors.values, [anchors.several()], buckets)

    shared = exchanged(chunks.select("chunk", "data"), fingerprints, _shared, "shared")
    shared = shared.withColumnRenamed("answers", "shared")
    whole = staged(copies(chunks), "copies")

    def sorted_run(row):
        chunk = Chunk(row["data"])
        left_out = set(row["copies"] or [])
        anchors = _Anchors(chunk, bits)
        shared_here = bits_of(anchors.values, row["shared"], buckets)[anchors.which]
        return chunk, left_out, anchors, _Run(anchors, shared_here, left_out)

    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(shared, "chunk", "left").join(whole, "chunk", "left")

    # splitters from the runs of a bounded number of chunks
    names = chunks.select("chunk").orderBy(F.xxhash64("chunk")).limit(SAMPLED_CHUNKS).collect()
    few = chunks.select("chunk", "data").filter(F.col("chunk").isin([r.chunk for r in names]))

    def sampled(batches):
        for batch in batches:
            for row in batch.to_pylist():
                strings = sorted_run(row)[3].strings()
                step = max(1, len(strings) // SAMPLES_PER_CHUNK)
                chosen = pa.array(strings[step // 2 :: step], pa.binary())
                yield pa.RecordBatch.from_arrays([chosen], names=["s"])

    # an anchor is cut only if it takes two splitters or more
    found = joined(few).mapInArrow(giving_back(sampled), "s binary").collect()
    sample = sorted(bytes(r.s) for r in found)
    chosen = {sample[len(sample) * k // ranges] for k in range(1, ranges)} if sample else set()
    times = Counter(s[:ANCHOR] for s in chosen)
    splitters = sorted({s if times[s[:ANCHOR]] > 1 else s[:ANCHOR] for s in chosen})
    sent = spark.sparkContext.broadcast(splitters)  # at most ``ranges`` strings
    divided = frozenset(a for a, n in times.items() if n > 1)

    known = joined(chunks.select("chunk", "data"))

    def runs_sent(row):
        return sorted_run(row)[3].sent(sent.value)

    def decided(data):
        return _decided(data, divided, MOST_CONTEXTS)

    merged_runs = exchanged(known, runs_sent, decided, "merged")
    rows = known.join(merged_runs.withColumnRenamed("answers", "merged"), "chunk", "left")

    def left_open(batches):
        for batch in batches:
            numbers = [
                sum(int((np.frombuffer(x["data"], np.uint32) == ASK).sum()) for x in answers)
                for answers in batch["answers"].to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["chunk"], pa.array(numbers, pa.int64())], names=["chunk", "n"]
            )

    asking = staged(merged_runs.mapInArrow(giving_back(left_open), "chunk long, n long").filter("n > 0"), "open")
    n_open = asking.agg(F.sum("n")).first()[0] or 0
    parts = max(8, n_open * (LEFT + 1) // VALUES_PER_BUCKET)
    if n_open:

        def strings_sent(row):
            run = sorted_run(row)[3]
            return _Strings(run, run.answers(sent.value, row["merged"])).sent(parts)

        asked = rows.join(asking, "chunk", "left_semi")
        strings = exchanged(asked, strings_sent, _smaller_elsewhere, "strings")
        rows = rows.join(strings.withColumnRenamed("answers", "strings"), "chunk", "left")

    def answers_of(run, row):
        answers = run.answers(sent.value, row["merged"])
        if row.get("strings"):
            strings = _Strings(run, answers)
            elsewhere = bits_of(strings.high, row["strings"], parts)
            answers[strings.open] = strings.masks(elsewhere)
        else:  # none has a whole string around it
            answers[answers == ASK] = 0
        return answers

    cut = _cut_characters if whole_characters else _cut

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk, left_out, anchors, run = sorted_run(row)
                number, start, end = _intervals(run, anchors, answers_of(run, row))
                masks = {
                    anchors.places[k]: covered(int(anchors.sizes[k]), start[at], end[at])
                    for k, at in by_document(number)
                }
                yield finished(chunk, masks, left_out, cut, schema)

    return rows.mapInArrow(giving_back(finish), schema)
