"""Substring dedup over words by fixed-block anchors.

The reference index holds every non-overlapping block of BLOCK words, block k at word k * BLOCK
of its document. Any window of WINDOW >= 2 * BLOCK - 1 words holds a whole block of the document
it stands in, so a window that repeats an earlier one shows that block somewhere among its own
rolling blocks. Every rolling block of every document probes the index; where a probe hits, the
windows around it are candidates, and so are those around the block that was hit. Candidates are
compared by the hash of the whole window (96 bits), the earliest place of each wins, and
neighbouring repeated windows join to maximal runs.

Blocks and windows are exchanged as sorted values between chunks (see ``chunks``). Documents
whose whole text a smaller id has too are settled by that alone.

Defined results: a null text is an empty one; rows without an id are kept whole and no source
of repeats; rows that share an id are not earlier than each other; extra columns are kept, but
for those that have the name of an added one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import words as W
from tillroll.llm.chunks import (
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
    received,
    result_schema,
    runs,
    sent_values,
)
from tillroll.llm.frames import without
from tillroll.session import staged

WINDOW, BLOCK = 20, 10
VALUES_PER_CHUNK = 175_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)
SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


class _Words:
    """Word hashes of the documents of a chunk that are long enough, and their blocks."""

    def __init__(self, chunk: Chunk, bits: int):
        places = list(chunk.distinct())
        self.documents = []  # (place, id, word hashes, block hashes), by id
        for i, hashes in zip(places, W.hashes_of([chunk.texts[i] for i in places]), strict=True):
            if len(hashes) >= WINDOW:
                self.documents.append((i, chunk.ids[i], hashes, W.joined(hashes, BLOCK)))
        drop = np.uint64(64 - bits)
        none = np.empty(0, np.uint64)
        rolled = np.concatenate([none, *[d[3] for d in self.documents]])
        self.blocks, self.which, counts = W.distinct(rolled >> drop << drop)
        sizes = [len(d[3]) for d in self.documents]
        starts = np.cumsum([0, *sizes])
        marks = [np.arange(a, b, BLOCK) for a, b in zip(starts, starts[1:], strict=False)]
        self.reference = np.zeros(len(self.blocks), bool)
        self.reference[self.which[np.concatenate([np.empty(0, np.int64), *marks])]] = True
        self.several = counts > 1

    def candidates(self, hit: np.ndarray, left_out: set[int]):
        """(first hash, second hash, document, start) of the windows that hold a hit block, in
        the documents not left out."""
        live, at, found = hit[self.which], 0, []
        for number, (place, _, hashes, rolled) in enumerate(self.documents):
            own = live[at : at + len(rolled)]
            at += len(rolled)
            if place in left_out or not own.any():
                continue
            total = np.concatenate([[0], np.cumsum(own)])
            n = len(hashes) - WINDOW + 1
            starts = np.flatnonzero(total[WINDOW - BLOCK + 1 :][:n] > total[:n])
            first = W.mixed(rolled[starts] * _SECOND + rolled[starts + BLOCK])
            second = W.joined(hashes, WINDOW, int(_SECOND))[starts]
            second = (second >> np.uint64(32)).astype(np.uint32)
            found.append((first, second, np.full(len(starts), number), starts))
        if not found:
            return [np.empty(0, t) for t in (np.uint64, np.uint32, np.int64, np.int64)]
        return [np.concatenate(x) for x in zip(*found, strict=True)]


class _Windows:
    """Candidate windows of a chunk; for each distinct one its earliest place."""

    def __init__(self, words: _Words, hit: np.ndarray, left_out: set[int]):
        first, second, number, start = words.candidates(hit, left_out)
        ids = np.array([d[1] for d in words.documents] or [0], np.int64)[number]
        order = np.lexsort((start, ids, second, first))
        self.first, self.second, self.ids = first[order], second[order], ids[order]
        self.number, self.start = number[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.first[1:] != self.first[:-1]) | (self.second[1:] != self.second[:-1])
        self.begins = np.nonzero(new)[0]
        self.group = np.cumsum(new) - 1

    def sent(self) -> tuple[np.ndarray, list[np.ndarray]]:
        at = self.begins
        return self.first[at], [self.second[at], self.ids[at], self.start[at]]

    def repeated(self, flagged: np.ndarray) -> np.ndarray:
        """Whether each candidate has an equal one earlier, here or (flagged) elsewhere."""
        at = self.begins[self.group]
        return _later(self.ids, self.start, at) | flagged[self.group]


def _later(ids: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (ids > ids[at]) | ((ids == ids[at]) & (start > start[at]))


def _hits(data: list[bytes]) -> list[bytes]:
    """Blocks that some document has as a reference block and that occur twice or more."""
    sizes, (values, reference, several) = received(data)
    order = np.argsort(values, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    starts = np.nonzero(new)[0]
    many = np.diff(np.append(starts, len(order))) > 1
    many |= np.logical_or.reduceat(several[order], starts)
    verdict = many & np.logical_or.reduceat(reference[order], starts)
    flat = np.empty(len(order), bool)
    flat[order] = verdict[np.cumsum(new) - 1]
    return bit_answers(sizes, flat)


def _earlier(data: list[bytes]) -> list[bytes]:
    """Windows of which another chunk has an earlier place."""
    sizes, (first, second, ids, start) = received(data)
    order = np.lexsort((start, ids, second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.nonzero(new)[0][np.cumsum(new) - 1]
    flat = np.empty(len(order), bool)
    flat[order] = _later(ids[order], start[order], at)
    return bit_answers(sizes, flat)


def _cut(text: bytes, mask: np.ndarray | bool | None) -> tuple:
    words = text.split()
    n = len(words)
    if mask is True:
        mask = np.full(n, n >= WINDOW)
    if mask is None or not mask.any():
        return n, [], b" ".join(words).decode()
    kept = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
    return n, [{"start": a, "end": b} for a, b in runs(mask)], b" ".join(kept).decode()


def remove(docs: DataFrame) -> DataFrame:
    """Add n_words, spans (maximal removed runs of words) and kept (the other words, joined by
    one space) to ``docs`` (doc_id, text and other columns); the text itself is not carried."""
    docs = without(docs, "n_words", "spans", "kept")
    schema = result_schema(
        docs.drop("text"),
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("kept", T.StringType()),
        ],
    )
    chunks = chunked(docs)
    buckets = n_buckets(chunks, VALUES_PER_CHUNK)
    bits = filter_bits(chunks, VALUES_PER_CHUNK)

    def blocks(row):
        words = _Words(Chunk(row["data"]), bits)
        return sent_values(words.blocks, [words.reference, words.several], buckets)

    hits = exchanged(chunks.select("chunk", "data"), blocks, _hits, "hits")
    whole = staged(copies(chunks), "copies")
    known = (
        chunks.select("chunk", "data")
        .join(hits.withColumnRenamed("answers", "hits"), "chunk", "left")
        .join(whole, "chunk", "left")
    )

    def windows(row):
        chunk = Chunk(row["data"])
        left_out = set(row["copies"] or [])
        words = _Words(chunk, bits)
        hit = bits_of(words.blocks, row["hits"], buckets)
        return chunk, left_out, words, _Windows(words, hit, left_out)

    def candidates(row):
        return sent_values(*windows(row)[3].sent(), buckets)

    earlier = exchanged(known, candidates, _earlier, "earlier")

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk, left_out, words, found = windows(row)
                flagged = bits_of(found.first[found.begins], row["earlier"], buckets)
                repeated = found.repeated(flagged)
                number, start = found.number[repeated], found.start[repeated]
                masks = {}
                for k, at in by_document(number):
                    place, _, hashes, _ = words.documents[k]
                    masks[place] = covered(len(hashes), start[at], start[at] + WINDOW)
                yield finished(chunk, masks, left_out, _cut, schema)

    rows = known.join(earlier.withColumnRenamed("answers", "earlier"), "chunk", "left")
    return rows.mapInArrow(finish, schema)
