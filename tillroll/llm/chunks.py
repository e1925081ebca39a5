"""Texts in chunks, and exchanges of sorted values between chunks.

A chunk is a row that holds some documents, all their columns included, as compressed Arrow
data. Work on the bytes or words of texts runs on whole chunks with numpy. To compare chunks,
each sends sorted lists of distinct values, a compressed list for every bucket of values, and
gets back one bit for each value it sent: a value shared by many documents is sent once by each
chunk, and no list or bucket grows with a group of copies. Chunks are written to the shared
folder first, so their numbers stay when a task runs again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillroll.llm.frames import give_back, giving_back, small_batches
from tillroll.session import staged

CHUNK_BYTES = 1_000_000  # of all columns; a longer document is a chunk by itself
ROW_BYTES = 64  # what a row counts beside its columns, so that empty ones are bounded too
VALUES_PER_BUCKET = 1_000_000


def squeezed(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def packed(*parts) -> bytes:
    return squeezed(pickle.dumps(parts, 5))


def unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def steps(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte by byte: the high bytes compress to nothing."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_steps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Chunk:
    """The documents of one row: ids (None if null) and texts as bytes."""

    def __init__(self, data: bytes):
        self.batch = pa.ipc.open_stream(zstandard.decompress(data)).read_next_batch()
        self.ids = self.batch["doc_id"].to_pylist()
        self.texts = [(t or "").encode() for t in self.batch["text"].to_pylist()]
        self.digests = [md5(t).digest() for t in self.texts]

    def distinct(self) -> Iterator[int]:
        """Places of the documents with an id whose text comes for the first time here, by id."""
        seen = set()
        for i in sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i], i)):
            if self.ids[i] is not None and self.digests[i] not in seen:
                seen.add(self.digests[i])
                yield i


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, ids, digests, data) of all rows, written to the shared folder."""
    small_batches(docs.sparkSession)

    def sealed(rows: pa.Table, number: int) -> pa.RecordBatch:
        (batch,) = rows.combine_chunks().to_batches()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        data = squeezed(sink.getvalue().to_pybytes())
        digests = [md5((t or "").encode()).digest() for t in batch["text"].to_pylist()]
        name = TaskContext.get().partitionId() << 32 | number
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name], pa.int64()),
                pa.array([batch["doc_id"].to_pylist()], pa.list_(pa.int64())),
                pa.array([digests], pa.list_(pa.binary())),
                pa.array([data], pa.binary()),
            ],
            names=["chunk", "ids", "digests", "data"],
        )

    def run(batches):
        held, size, number = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum([ROW_BYTES + batch.slice(i, 1).nbytes for i in range(batch.num_rows)])
            start = 0
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                end = int(np.searchsorted(sizes, done + CHUNK_BYTES - size, "right"))
                end = max(end, start + (not held))
                held.append(batch.slice(start, end - start))
                size += int(sizes[end - 1] - done) if end > start else 0
                start = end
                if start < batch.num_rows:
                    yield sealed(pa.Table.from_batches(held), number)
                    held, size, number = [], 0, number + 1
        if held:
            yield sealed(pa.Table.from_batches(held), number)

    schema = "chunk long, ids array<long>, digests array<binary>, data binary"
    return staged(docs.mapInArrow(giving_back(run), schema), "chunks")


def copies(chunks: DataFrame) -> DataFrame:
    """(chunk, copies): places of documents whose whole text a smaller id has too."""
    each = chunks.select(
        "chunk", F.posexplode_outer(F.arrays_zip("ids", "digests")).alias("place", "doc")
    ).select("chunk", "place", "doc.*")
    each = each.filter(F.col("ids").isNotNull())
    least = each.groupBy("digests").agg(F.min("ids").alias("least"), F.count("*").alias("n"))
    later = each.join(least.filter("n > 1"), "digests").filter("ids > least")
    return later.groupBy("chunk").agg(F.collect_list("place").alias("copies"))


def n_buckets(chunks: DataFrame, values_per_chunk: int) -> int:
    return max(8, chunks.count() * values_per_chunk // VALUES_PER_BUCKET)


def filter_bits(chunks: DataFrame, values_per_chunk: int) -> int:
    """Length of fingerprints of which about one in a thousand is equal to another by chance."""
    return min(64, 10 + (chunks.count() * values_per_chunk + 1).bit_length())


def exchanged(
    rows: DataFrame,
    send: Callable[[dict], Iterable[tuple[int, bytes]]],
    decide: Callable[[list[bytes]], list[bytes]],
    label: str,
) -> DataFrame:
    """(chunk, answers): for each chunk row the answers, (bucket, data), to what it sent.

    ``send`` gives (bucket, data) of a row; ``decide`` gets all data sent to a bucket and
    returns an answer to each.
    """

    def out(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = list(send(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in found], pa.int32()),
                        pa.array([row["chunk"]] * len(found), pa.int64()),
                        pa.array([data for _, data in found], pa.binary()),
                    ],
                    names=["bucket", "chunk", "data"],
                )

    def back(table: pa.Table) -> pa.Table:
        replies = decide(table["data"].to_pylist())
        give_back()
        return pa.table(
            {
                "chunk": table["chunk"],
                "bucket": table["bucket"],
                "data": pa.array(replies, pa.binary()),
            }
        )

    sent = rows.mapInArrow(giving_back(out), "bucket int, chunk long, data binary")
    answers = sent.groupBy("bucket").applyInArrow(back, "chunk long, bucket int, data binary")
    grouped = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    return staged(grouped, label)


def value_slices(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that sorted 64-bit values fall into."""
    edges = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)
    ends = [0, *np.searchsorted(values, edges).tolist(), len(values)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]


def sent_values(values: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    for k, a, b in value_slices(values, buckets):
        yield k, packed(steps(values[a:b]), *[c[a:b] for c in columns])


def received(data: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
    """Length of each list that was sent, and the values and columns of all joined."""
    parts = [unpacked(x) for x in data]
    values = [from_steps(p[0]) for p in parts]
    columns = [np.concatenate([p[k] for p in parts]) for k in range(1, len(parts[0]))]
    return [len(v) for v in values], [np.concatenate(values), *columns]


def bit_answers(sizes: list[int], flat: np.ndarray) -> list[bytes]:
    return [np.packbits(x).tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def bits_of(values: np.ndarray, answers: list[dict] | None, buckets: int) -> np.ndarray:
    """The answers of one bit for a chunk's sorted values, in their order."""
    found = np.zeros(len(values), bool)
    known = {x["bucket"]: x["data"] for x in answers or []}
    for k, a, b in value_slices(values, buckets):
        found[a:b] = np.unpackbits(np.frombuffer(known[k], np.uint8), count=b - a)
    return found


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a mask, as (start, end)."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def by_document(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each document number with the places where it stands."""
    order = np.argsort(number, kind="stable")
    ordered = number[order]
    ends = [*np.nonzero(np.diff(ordered, prepend=-1))[0].tolist(), len(ordered)]
    for a, b in zip(ends, ends[1:], strict=False):
        yield int(ordered[a]), order[a:b]


def finished(
    chunk: Chunk,
    masks: dict[int, np.ndarray],
    whole: set[int],
    cut: Callable[[bytes, np.ndarray | bool], tuple],
    schema: T.StructType,
) -> pa.RecordBatch:
    """The rows of a chunk without the text, with what ``cut`` makes of each text and of its
    mask; True stands for the mask of a whole copy. Rows equal in id and text are alike."""
    of_text = {(chunk.ids[i], chunk.digests[i]): mask for i, mask in masks.items()}
    made = []
    for i, text in enumerate(chunk.texts):
        if i in whole:
            mask = True
        elif chunk.ids[i] is None:
            mask = None
        else:
            mask = of_text.get((chunk.ids[i], chunk.digests[i]))
        made.append(cut(text, mask))
    arrow = to_arrow_schema(schema)
    names = [c for c in chunk.batch.schema.names if c != "text"]
    columns = [chunk.batch[c] for c in names]
    for field, values in zip(list(arrow)[len(names) :], zip(*made, strict=True), strict=True):
        columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, names=arrow.names)


def result_schema(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *added])
