"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has one valid last token: the one whose predecessor's prefix
ends in a token with which it stays unmerged. A piece is thus encoded by filling an array,
``last[i]`` for the prefix of i bytes, and following it back from the end. The array of a
prefix does not depend on what follows, so appended bytes extend it, and an edit only
refills it from the edited byte on.

Whether two tokens stay apart is judged by the merges of the rank file. A rank file in which
a token's own bytes do not merge into it can leave a gap in the array; such a piece is merged
directly.

Defined results: a null text is encoded as an empty one; null ids decode to an empty text;
extra columns are kept, but for those that have the name of an added one: it replaces them.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.frames import giving_back, small_batches, without

CACHED_PIECES = 300_000
CACHED_PAIRS = 300_000
LONGEST_CACHED = 64
ROWS_AT_ONCE = 256
PIECES_AT_ONCE = 50_000


class Vocabulary:
    """Ranks of byte strings, the token pairs that stay apart, and a cache of pieces."""

    def __init__(self, rank_file: bytes):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self._sized = {rank: (len(token), rank) for token, rank in self.ranks.items()}
        #: every beginning of a token: lengths and ids of the tokens that it ends in, longest
        #: first, or False until ``ending`` is asked for them
        self.beginnings: dict[bytes, tuple[tuple[int, int], ...] | bool] = {
            t[:n]: False for t in self.ranks for n in range(1, len(t) + 1)
        }
        self.known_pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.halves = _Halves(self)
        self.pieces = _PieceCache(self)

    def parts(self, data: bytes, few: int = 1) -> list[bytes]:
        """The bytes after merging, again and again, the leftmost pair of lowest rank, until
        nothing merges or so few parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > few:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, data: bytes) -> list[int]:
        """Ids after all merges."""
        return [self.ranks[p] for p in self.parts(data)]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes merge into it."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.token_bytes[token]) == [token]
        return known

    def ending(self, data: bytes) -> tuple[tuple[int, int], ...]:
        """Lengths and ids of the tokens that the bytes end in, the longest first."""
        found = (self.ranks.get(data[n:]) for n in range(len(data)))
        tokens = tuple(self._sized[token] for token in found if token is not None)
        self.beginnings[data] = tokens
        return tokens

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, written side by side, are encoded as themselves."""
        if len(self.known_pairs) >= CACHED_PAIRS:
            self.known_pairs.clear()
        fits = self.known_pairs[left << 32 | right] = self._stay_apart(left, right)
        return fits

    def _stay_apart(self, left: int, right: int) -> bool:
        """Goes back through the merges that made the two, the last one first. No tokens that met
        at the seam may merge sooner than the next merge beside it; of equal ranks the merge
        further left comes first."""
        rank, token_bytes, halves = self.ranks.get, self.token_bytes, self.halves
        of_left, of_right = halves[left], halves[right]
        if of_left is None or of_right is None:
            return self.merged(token_bytes[left] + token_bytes[right]) == [left, right]
        limit = None
        while True:
            across = rank(token_bytes[left] + token_bytes[right])
            if across is not None and (limit is None or across < limit):
                return False
            if of_left and (left > right or not of_right):
                limit, left = left, of_left[1]
                of_left = halves[left]
            elif of_right:
                limit, right = right + 1, of_right[0]
                of_right = halves[right]
            else:
                return True


class _Halves(dict):
    """Token to the two whose merge makes it, none for a single byte; None if its own merges do
    not make it, or not in the order of their ranks."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: int) -> tuple[int, ...] | None:
        words, found = self.vocabulary, ()
        data = words.token_bytes[token]
        if len(data) > 1:
            parts = words.parts(data, 2)
            found = tuple(words.ranks.get(p) for p in parts)
            in_order = len(parts) == 2 and all(
                half is not None and (len(p) == 1 or (half < token and self[half] is not None))
                for p, half in zip(parts, found, strict=True)
            )
            found = found if in_order else None
        self[token] = found
        return found


class PrefixTable:
    """The last token of every byte prefix of one piece; grows by appends, follows edits."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last = [-1]
        #: where the longest end of each prefix begins that a token begins with
        self.begins = [0]
        self.append(piece)

    def append(self, more: bytes) -> PrefixTable:
        """Bytes added at the end; what is known of the old prefixes stays."""
        words, old = self.vocabulary, len(self.piece)
        piece = self.piece = self.piece + more
        last, begins = self.last, self.begins
        known, pair, begin = words.beginnings.get, words.known_pairs.get, begins[-1]
        for end in range(old + 1, len(piece) + 1):
            tokens = known(piece[begin:end])
            while tokens is None:
                begin += 1
                tokens = known(piece[begin:end]) if begin < end else ()
            if tokens is False:
                tokens = words.ending(piece[begin:end])
            found = -1
            for size, token in tokens:
                if size < end:
                    before = last[end - size]
                    if before < 0:
                        continue
                    fits = pair(before << 32 | token)
                    if fits is None:
                        fits = words.apart(before, token)
                else:
                    fits = words.whole(token)
                if fits:
                    found = token
                    break
            last.append(found)
            begins.append(begin)
        return self

    def changed_to(self, piece: bytes) -> PrefixTable:
        """The table of another piece; prefixes that both pieces share are taken over."""
        table = PrefixTable(self.vocabulary)
        table.piece, table.last, table.begins = self.piece, self.last[:], self.begins[:]
        return table.become(piece)

    def become(self, piece: bytes) -> PrefixTable:
        """This table itself changed to that of another piece."""
        shared = 0
        for mine, other in zip(self.piece, piece, strict=False):
            if mine != other:
                break
            shared += 1
        self.piece = piece[:shared]
        del self.last[shared + 1 :], self.begins[shared + 1 :]
        return self.append(piece[shared:])

    def ids(self) -> list[int] | None:
        """Tokens of the whole piece, or None if the array does not settle it."""
        out, at, words = [], len(self.piece), self.vocabulary
        while at > 0:
            token = self.last[at]
            if token < 0:
                return None
            out.append(token)
            at -= len(words.token_bytes[token])
        return out[::-1]

    def encoded(self) -> list[int]:
        """As the merges of the rank file encode the piece; a piece that is a token is that."""
        if not self.piece:
            return []
        whole = self.vocabulary.ranks.get(self.piece)
        if whole is not None:
            return [whole]
        ids = self.ids()
        return self.vocabulary.merged(self.piece) if ids is None else ids


class _PieceCache(dict):
    """Piece of text to its ids as little-endian bytes. When full, its entries become the old
    ones, which are taken over again as they are asked for, and the old ones before go."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old, self.limit = vocabulary, {}, CACHED_PIECES

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).encoded()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            self._keep(piece, packed)
        return packed

    def _keep(self, piece: str, packed: bytes) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = packed

    def learn(self, found: list[list[str]]) -> None:
        """Encode what is new among the pieces of some texts. They are taken in order, so that
        each table takes over from the one before what both pieces begin with."""
        old, ranks = self.old, self.vocabulary.ranks
        new = [
            p for p in set().union(*found) if len(p) <= LONGEST_CACHED and p not in self and p not in old
        ]
        table = PrefixTable(self.vocabulary)
        for piece in sorted(new):
            data = piece.encode()
            whole = ranks.get(data)
            ids = table.become(data).encoded() if whole is None else [whole]
            self._keep(piece, struct.pack(f"<{len(ids)}I", *ids))


def matches(pattern: regex.Pattern, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
    """Where the pieces of the text from ``start`` on begin and end."""
    return (m.span() for m in pattern.finditer(text, start))


def safe_start(text: str, spans: list[tuple[int, int]], edit: int) -> int:
    """How many pieces lie so far before ``edit`` that no change from there on reaches them.

    The pattern looks at most two characters beyond a piece, or over the white space that
    the piece begins.
    """
    kept = len(spans)
    while kept and (
        spans[kept - 1][1] + 2 >= edit
        or spans[kept - 1][0] + 3 >= edit
        or text[spans[kept - 1][1] : edit].isspace()
    ):
        kept -= 1
    return kept


class EditableText:
    """A text with its pieces and ids, re-encoded only near each edit."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.spans = text, []
        self.tables: list[PrefixTable] = []
        self._scan(0, text)

    def _scan(self, kept: int, text: str, old: dict[int, int] | None = None) -> None:
        """Pieces after the first ``kept``; where an old piece begins again, old ones follow.

        ``old`` gives, by place in the new text, the number of the old piece that starts there.
        """
        spans, tables = self.spans[:kept], self.tables[:kept]
        shift = len(text) - len(self.text)
        for start, end in matches(self.pattern, text, spans[-1][1] if spans else 0):
            if old and start in old:
                k = old[start]
                spans += [(a + shift, b + shift) for a, b in self.spans[k:]]
                tables += self.tables[k:]
                break
            piece, k = text[start:end].encode(), len(spans)
            if k == kept and k < len(self.spans) and self.spans[k][0] == start:
                table = self.tables[k].changed_to(piece)
            else:
                table = PrefixTable(self.vocabulary, piece)
            spans.append((start, end))
            tables.append(table)
        self.text, self.spans, self.tables = text, spans, tables

    def append(self, more: str) -> EditableText:
        self._scan(safe_start(self.text, self.spans, len(self.text)), self.text + more)
        return self

    def replace(self, start: int, end: int, new: str) -> EditableText:
        """Characters [start, end) replaced by ``new``."""
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        old = {a + shift: k for k, (a, _) in enumerate(self.spans) if a >= end}
        kept = safe_start(self.text, self.spans, start)
        self._scan(kept, text, old)
        return self

    def ids(self) -> list[int]:
        return [i for table in self.tables for i in table.encoded()]


@lru_cache(maxsize=2)
def vocabulary(rank_file: bytes) -> Vocabulary:
    return Vocabulary(rank_file)


@lru_cache(maxsize=2)
def tokens(rank_file: bytes) -> dict[int, bytes]:
    """The bytes of every id: all that decoding needs."""
    lines = (line.split() for line in rank_file.splitlines() if line.strip())
    return {int(rank): base64.b64decode(token) for token, rank in lines}


def _read(path: str) -> bytes:
    """A rank file, of bounded size: it goes to the tasks with their code."""
    with open(path, "rb") as file:
        return file.read()


def _schema(df: DataFrame, *added: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *added])


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _in_groups(found: Iterable[list[str]]) -> Iterator[list[list[str]]]:
    """The pieces of text after text, some texts at a time: more only of a long text."""
    group, n = [], 0
    for pieces in found:
        group.append(pieces)
        n += len(pieces)
        if n >= PIECES_AT_ONCE:
            yield group
            group, n = [], 0
    yield group


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def _forgetting(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` without the vocabularies that its worker would keep for the next task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            vocabulary.cache_clear()
            tokens.cache_clear()
            gc.collect()  # a vocabulary and its pieces name each other

    return wrapped


def encode(
    df: DataFrame,
    rank_path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    n_tokens: str = "n_tokens",
    cached_pieces: int = CACHED_PIECES,
    keep: bool = True,
) -> DataFrame:
    """Add the ids of each whole text, as little-endian unsigned 32-bit integers, and their
    number. Each match of ``pattern`` is encoded separately, without special tokens.

    A worker keeps the ids of up to twice ``cached_pieces`` pieces, about 230 bytes each, also
    between tasks: more is faster, less leaves room for what else runs there. Without ``keep``
    each task makes its own vocabulary and leaves none."""
    small_batches(df.sparkSession)
    df = without(df, ids, n_tokens)
    shared = df.sparkSession.sparkContext.broadcast(_read(rank_path))

    def run(batches):
        find = regex.compile(pattern).findall
        known = vocabulary(shared.value).pieces
        known.limit = cached_pieces
        lookup = known.__getitem__
        for batch in _sliced(batches):
            packed = []
            for group in _in_groups(find(t) if t else [] for t in batch[text].to_pylist()):
                known.learn(group)
                packed += [b"".join(map(lookup, pieces)) for pieces in group]
            yield _with(
                batch,
                **{
                    ids: pa.array(packed, pa.binary()),
                    n_tokens: pa.array([len(p) // 4 for p in packed], pa.int64()),
                },
            )

    schema = _schema(
        df, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())
    )
    return df.mapInArrow(giving_back(run if keep else _forgetting(run)), schema)


def decode(
    df: DataFrame,
    rank_path: str,
    ids: str = "ids",
    decoded: str = "decoded",
    keep: bool = True,
) -> DataFrame:
    """Add the bytes that the ids stand for; ``keep`` as in ``encode``."""
    df = without(df, decoded)
    shared = df.sparkSession.sparkContext.broadcast(_read(rank_path))

    def run(batches):
        lookup = tokens(shared.value).__getitem__
        for batch in _sliced(batches):
            out = [
                b"".join(map(lookup, memoryview(p).cast("I"))) if p else b""
                for p in batch[ids].to_pylist()
            ]
            yield _with(batch, **{decoded: pa.array(out, pa.binary())})

    task = giving_back(run if keep else _forgetting(run))
    return df.mapInArrow(task, _schema(df, T.StructField(decoded, T.BinaryType())))


def append_text(
    df: DataFrame,
    rank_path: str,
    pattern: str,
    text: str = "text",
    more: str = "more",
    ids: str = "ids",
) -> DataFrame:
    """Add the ids of ``text`` followed by ``more``: the prefix table of the text is kept."""
    df = without(df, ids)
    shared = df.sparkSession.sparkContext.broadcast(_read(rank_path))

    def run(batches):
        words = vocabulary(shared.value)
        for batch in _sliced(batches):
            out = []
            for old, new in zip(batch[text].to_pylist(), batch[more].to_pylist(), strict=True):
                whole = EditableText(words, pattern, old or "").append(new or "")
                out.append(struct.pack(f"<{len(whole.ids())}I", *whole.ids()))
            yield _with(batch, **{ids: pa.array(out, pa.binary())})

    return df.mapInArrow(run, _schema(df, T.StructField(ids, T.BinaryType())))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Lowercase hex SHA-256 of ids and of decoded bytes in place of the bytes."""
    return df.withColumns(
        {"ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2(decoded, 256)}
    ).drop(ids, decoded)
