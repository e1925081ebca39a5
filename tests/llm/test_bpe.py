import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from tillroll.llm import bpe, frames
from tillroll.llm.registry import RANKS, op1_bpe

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(bpe._read(PATH))


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def some_text(rng, n):
    parts = ["the", " ", "  ", "\n", "'re", "'", "É", "ß", "12", "...", "\t", "日本", "x" * 9, "I'll", "🙂"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_pieces_encode_as_the_library_does(words, theirs):
    rng = random.Random(3)
    for _ in range(3000):
        piece = bytes(rng.choice(b"aeinstroh l\xc3\xa9\xe6\x97") for _ in range(rng.randint(1, 40)))
        assert bpe.PrefixTable(words, piece).encoded() == theirs._encode_single_piece(piece)


def test_appends_are_exact(words, theirs):
    rng = random.Random(4)
    for _ in range(300):
        text, more = some_text(rng, rng.randint(0, 12)), some_text(rng, rng.randint(0, 6))
        grown = bpe.EditableText(words, public_tokenizers.PATTERN, text).append(more)
        assert grown.ids() == theirs.encode_ordinary(text + more), (text, more)


def test_edits_are_exact(words, theirs):
    rng = random.Random(5)
    for _ in range(600):
        text = some_text(rng, rng.randint(0, 20))
        edited = bpe.EditableText(words, public_tokenizers.PATTERN, text)
        for _ in range(3):
            start = rng.randint(0, len(edited.text))
            end = min(len(edited.text), start + rng.randint(0, 6))
            edited.replace(start, end, some_text(rng, rng.randint(0, 3)))
            assert edited.ids() == theirs.encode_ordinary(edited.text)


def test_an_edit_keeps_the_tables_of_untouched_pieces(words):
    text = bpe.EditableText(words, public_tokenizers.PATTERN, "one two three four five six")
    before = list(text.tables)
    text.replace(14, 18, "7")
    assert text.tables[0] is before[0] and text.tables[-1] is before[-1]


def test_query_matches_the_library_over_whole_texts(spark, theirs):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r.doc_id: r for r in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(documents)
    for doc in documents:
        ids = theirs.encode_ordinary(doc.text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()


def test_nulls_empty_long_and_extra_columns(spark, theirs):
    long = "word " * 40_000 + "y" * 30_000
    rows = [(1, None, None), (2, "", "a"), (3, long, "b"), (3, long, "b"), (4, "a\x1cb\x85c", "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, tokens string")
    coded = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    for row in coded:
        expected = theirs.encode_ordinary(row.text or "")
        assert list(memoryview(bytes(row.ids)).cast("I")) == expected
        assert bytes(row.decoded).decode() == (row.text or "")
    assert len(coded) == 5 and {r.tokens for r in coded} == {None, "a", "b", ""}
    empty = bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN)
    assert empty.count() == 0
    clash = bpe.encode(df.withColumnRenamed("tokens", "IDS"), PATH, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "ids", "n_tokens"] and clash.count() == 5


def test_a_pair_is_judged_without_merging_its_bytes(monkeypatch):
    own = bpe.Vocabulary(bpe._read(PATH))
    rng, tokens = random.Random(6), sorted(own.token_bytes)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    pairs += [(rng.choice(tokens[:600]), rng.choice(tokens[:600])) for _ in range(3000)]
    merged = [own.merged(own.token_bytes[a] + own.token_bytes[b]) == [a, b] for a, b in pairs]
    monkeypatch.setattr(own, "merged", None)
    assert [own.apart(a, b) for a, b in pairs] == merged and len(set(merged)) == 2


def test_pairs_of_any_rank_file_are_judged_as_their_bytes_merge():
    """Also where ranks are in no order, tokens are not made by their own merges, bytes lack."""
    rng = random.Random(7)
    for _ in range(300):
        tokens = {bytes(rng.choice(b"aabc") for _ in range(rng.randint(2, 6))) for _ in range(12)}
        tokens = [b"a", b"b", b"c", *sorted(tokens, key=lambda t: (len(t) + rng.randint(0, 3), t))]
        if rng.random() < 0.3:
            rng.shuffle(tokens)
        lines = [base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)]
        own = bpe.Vocabulary(b"\n".join(lines))
        for a in own.token_bytes:
            for b in own.token_bytes:
                data = own.token_bytes[a] + own.token_bytes[b]
                assert own.apart(a, b) == (own.merged(data) == [a, b]), (tokens, a, b)
    lacking = bpe.Vocabulary(b"YWI= 0\nYQ== 1\nYmE= 2")  # ab, a and ba, no b
    assert lacking.apart(1, 1) and not lacking.apart(1, 2)


def test_new_pieces_take_over_what_the_one_before_begins_with(theirs, monkeypatch):
    own, filled = bpe.Vocabulary(bpe._read(PATH)), []
    append = bpe.PrefixTable.append
    monkeypatch.setattr(
        bpe.PrefixTable, "append", lambda table, more: filled.append(len(more)) or append(table, more)
    )
    stem = "qzxjk" * 6
    group = [[stem + end for end in ("a", "bq", "bqz", "c")], [stem + "a", "x" * 100], []]
    own.pieces.learn(group)
    assert sum(filled) == len(stem) + 5 and len(own.pieces) == 4
    for piece in (p for pieces in group for p in pieces):
        assert list(memoryview(own.pieces[piece]).cast("I")) == theirs.encode_ordinary(piece)
    own.pieces.limit, before = 2, dict(own.pieces)
    own.pieces.learn([[f"{stem}{n}" for n in "defgh"]])
    assert {p: own.pieces[p] for p in before} == before


def test_pieces_are_held_for_some_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 3)
    found = [["a"], [], ["b", "c", "d", "e"], ["f"]]
    assert list(bpe._in_groups(found)) == [found[:3], found[3:]]
    assert list(bpe._in_groups([])) == [[]]


def test_append_operator(spark, theirs):
    df = spark.createDataFrame([(None, None), ("I", "'ll  "), ("a  ", " b")], "text string, more string")
    for row in bpe.append_text(df, PATH, public_tokenizers.PATTERN).collect():
        expected = theirs.encode_ordinary((row.text or "") + (row.more or ""))
        assert list(memoryview(bytes(row.ids)).cast("I")) == expected


def test_the_pattern_splits_as_the_library_does(words, theirs):
    find = regex.compile(public_tokenizers.PATTERN).findall
    for char in map(chr, [*range(1, 0x300), 0x1680, 0x180E, 0x2003, 0x2028, 0x200B, 0x3000, 0xFEFF]):
        text = f"a{char}{char} b{char}c  {char}"
        ids = [i for p in find(text) for i in bpe.PrefixTable(words, p.encode()).encoded()]
        assert ids == theirs.encode_ordinary(text), hex(ord(char))


def test_a_task_that_keeps_nothing_leaves_no_vocabulary(spark, theirs):
    """The pipeline's workers go on with other stages."""
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id int, text string")
    coded = bpe.encode(df, PATH, public_tokenizers.PATTERN, keep=False)
    row = bpe.decode(coded, PATH, keep=False).where("doc_id = 1").first()
    assert list(memoryview(bytes(row.ids)).cast("I")) == theirs.encode_ordinary("one two")
    assert bytes(row.decoded) == b"one two"

    def run(batches):
        for batch in batches:
            yield len(bpe.vocabulary(b"YQ== 0").ranks) + len(bpe.tokens(b"YQ== 0")) + batch

    assert list(bpe._forgetting(run)(iter([1, 2]))) == [3, 4]
    assert bpe.vocabulary.cache_info().currsize == bpe.tokens.cache_info().currsize == 0


def test_free_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(frames, "give_back", lambda: calls.append("given"))
    for batch in frames.giving_back(lambda batches: (b * 2 for b in batches))(iter([1, 2])):
        calls.append(batch)
    assert calls == [2, 4, "given"]
