import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ambler.llm import token_counts, token_files

from .conftest import EDGE, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = list("abcXYZ éÉßİıΣσς'’\"<|>0123²½Ⅷ\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　́é中文字한🙂‍,.!?-_ #$%") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "don't", " the ", "  ", "\n\n"]
EDGES = [*EDGE, (9, "a <|endoftext|> b<|startoftext|>"), (10, "x\xa0\n y  z　"), (11, words(3000, 1))]


@pytest.fixture(scope="module")
def fuzz():
    r = random.Random(3)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 14))) for _ in range(3000)]


def tokens_of(table, library, texts):
    """Tokens of each text from its pieces and their frequencies."""
    text, piece, times, names = table.cut(pa.array(texts, pa.string()))
    own = np.array([len(library.encode(p, add_special_tokens=False).ids) for p in names.to_pylist()] or [0], np.int64)
    return np.bincount(text, own[piece] * times, len(texts)).astype(int).tolist()


def test_counts_equal_the_library(fuzz):
    library, table = Tokenizer.from_file(BYTE), token_counts.PreTokens(BYTE)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in fuzz]
    assert tokens_of(table, library, fuzz) == want
    for t, n in zip(fuzz[:500], want, strict=False):
        assert tokens_of(table, library, [t]) == [n], repr(t)
        assert sum(k * len(library.encode(p, add_special_tokens=False).ids) for p, k in table.pieces(t).items()) == n, repr(t)
    assert tokens_of(table, library, [None, "", None]) == [0, 0, 0] and tokens_of(table, library, []) == []


def test_rare_pieces_are_joined_by_shuffle(docs):
    want = sorted(token_counts.count_tokens(docs(EDGES), BYTE).collect(), key=str)
    assert sorted(token_counts.count_tokens(docs(EDGES), BYTE, heavy=3).collect(), key=str) == want
    ints = docs(EDGES).withColumn("doc_id", F.col("doc_id").cast("int"))
    assert sorted(token_counts.count_tokens(ints, BYTE).collect(), key=str) == want


def test_frequent_pieces_are_within_their_bound(spark):
    """All rows of a count stand together, on one side of the bound or the other."""
    counts = [5000, 900, 900, 40, 17, 17, 17, 3, 3] + [2] * 20 + [1] * 50
    table = spark.createDataFrame([(f"p{k}", n, 1) for k, n in enumerate(counts)], "piece string, n long, tokens int")
    for heavy, want in ((0, 0), (1, 1), (2, 1), (3, 3), (6, 4), (7, 7), (28, 9), (29, 29), (78, 29), (79, 79)):
        got = [r.n for r in token_counts.frequent(table, heavy).collect()]
        assert sorted(got, reverse=True) == counts[:want]


def test_each_piece_is_counted_once(docs):
    table = token_counts.token_table(token_counts.piece_counts(docs(EDGES), BYTE), BYTE).collect()
    library, want = Tokenizer.from_file(BYTE), Counter()
    for _, t, *_ in EDGES:
        want.update(token_counts.PreTokens(BYTE).pieces(t or ""))
    assert {r.piece: (r.n, r.tokens) for r in table} == {p: (n, len(library.encode(p, add_special_tokens=False).ids)) for p, n in want.items()}
    assert len(table) == len(want)


def test_word_ids_equal_the_library(fuzz):
    library, table = Tokenizer.from_file(WORD), token_files.WordIds(WORD, "<u2")
    for t in fuzz:
        assert np.frombuffer(table.encode(t.encode()), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_texts_together_equal_texts_alone(fuzz):
    table, other = token_files.WordIds(WORD, "<u2"), token_files.WordIds(WORD, "<u2")
    texts = [*fuzz, None, "", "  "]
    ids, n = table.encode_all(pa.array(["cut off", *texts]).slice(1))
    want = [other.encode((t or "").encode()) for t in texts]
    assert ids.tobytes() == b"".join(want) and [2 * x for x in n] == list(map(len, want))


def test_tables_may_start_anew(monkeypatch, fuzz):
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", 5)
    monkeypatch.setattr(token_files, "WORD_ENTRIES", 5)
    monkeypatch.setattr(token_files, "PIECE_ENTRIES", 5)
    a, b = token_counts.PreTokens(BYTE), token_files.WordIds(WORD, "<u2")
    lib_a, lib_b = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for t in fuzz[:300]:
        assert tokens_of(a, lib_a, [t]) == [len(lib_a.encode(t, add_special_tokens=False).ids)]
        assert np.frombuffer(b.encode(t.encode()), "<u2").tolist() == lib_b.encode(t, add_special_tokens=False).ids


def test_count_operator(docs):
    library = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(docs(EDGES), BYTE).collect()
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n(t), n(t) > 1024) for i, t, *_ in EDGES]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_counts.count_tokens(docs([]), BYTE).count() == 0


# ------------------------------------------------------------------- codes

def kraft(lengths):
    return sum(2.0 ** -int(n) for n in lengths if n)


@pytest.mark.parametrize("counts", [[5], [1, 1], [1, 0, 2, 4, 8, 16, 32, 64], list(range(300)), [2**k for k in range(40)]])
def test_lengths_are_a_complete_limited_code(counts):
    lengths = token_files.code_lengths(np.array(counts), 16)
    assert lengths.max() <= 16 and all((n > 0) == (c > 0) for n, c in zip(lengths, counts, strict=True))
    if sum(c > 0 for c in counts) > 1:
        assert kraft(lengths) == 1.0


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq

    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, 60)
    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((token_files.code_lengths(counts, 16) * counts).sum()) == cost


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3000).astype(np.uint16)
    counts = np.bincount(np.concatenate([ids, [7]]), minlength=3001)
    lengths = token_files.code_lengths(counts)
    data = token_files.pack(ids, lengths, token_files.canonical_codes(lengths))
    table = token_files.decode_table(lengths)
    assert np.array_equal(token_files.unpack(data, table), ids)
    if n > 600:  # any block by itself
        assert np.array_equal(token_files.unpack(data, table, blocks=slice(1, 2)), ids[256:512])


def test_files_round_trip(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 700)
    library = Tokenizer.from_file(WORD)
    path = str(tmp_path / "ids")
    token_files.write_ids(docs(EDGES), WORD, path)
    got = token_files.read_ids(spark, path, with_ids=True).collect()
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t, *_ in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.start)] == want


def test_files_of_an_empty_table(docs):
    assert token_files.token_files(docs([]), WORD).count() == 0


def test_not_a_chunk():
    with pytest.raises(ValueError):
        token_files.unpack(b"XXXX", np.zeros(1 << 16, np.uint32))


def test_more_ids_than_sixteen_bits_have_codes():
    r = np.random.default_rng(2)
    counts = r.integers(1, 50, 70_000)
    lengths = token_files.code_lengths(counts)
    assert 16 < lengths.max() <= 18 and sum(2.0 ** -lengths.astype(float)) <= 1
    ids = r.integers(0, 70_000, 5000).astype("<u4")
    data = token_files.pack(ids, lengths, token_files.canonical_codes(lengths))
    assert np.array_equal(token_files.unpack(data, token_files.decode_table(lengths)), ids)


def test_many_rows_without_an_id_are_spread(docs):
    rows = [(None, words(20, k)) for k in range(400)] + [(k, words(5, k)) for k in range(20)]
    got = token_files.token_files(docs(rows), WORD).collect()
    assert len(got) == 420 and sum(r.doc_id is None for r in got) == 400
    at = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1].tolist()]
    assert max(r.start for r in got if r.doc_id is None) < min(r.start for r in got if r.doc_id is not None)


def test_words_leave_the_workers_that_pack_and_read(spark, monkeypatch):
    """Tasks that write and read chunks don't hold the tokenizer's tables meanwhile."""
    made, kind = [], type(spark.range(1))
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, *rest: (made.append(f), own(df, f, *rest))[1])
    docs = spark.createDataFrame([(k, words(200, k)) for k in range(40)], "doc_id long, text string")
    assert token_files.token_files(docs, WORD).count() == 40
    assert len(made) == 3
    for f in made[1:]:  # after the one that cuts texts
        token_files._word_ids(WORD, "<u2").encode(b"some words")
        assert list(f(iter([]))) == [] and not token_files._words
