"""Token ids in canonical Huffman files.

A document's ids are its tokens and an end id. Ids of all documents in ascending
``doc_id`` order are cut into chunks, each a record with its own code stream. A
code is at most 16 bits long, or what more symbols need (package-merge over the ids'
counts in the whole table), codes are canonical, so a codebook is one length per id. Inside a chunk
every block of ``BLOCK`` ids has a checkpoint, the bit at which it starts, and
blocks are decoded independently of each other by one table lookup per id.

Layout, as written in a folder that executors share:

codebook/  symbol int, length int              one row per id that occurs
chunks/    part int, seq int                   order of chunks
           local_start long                    ids before this chunk in its part
           n_ids long
           doc_ids array<long>, doc_lens array<int>
           data binary                         magic 'HUF1', u32 ids, u32 block
                                               size, u32 blocks, u64 bit offsets
                                               of blocks, then the codes, highest
                                               bit first, little padding zeros
"""

from __future__ import annotations

import array
import json
import os
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Longest code, unless more ids occur than it has codes.
MAX_BITS = 16
BLOCK = 256
#: Ids of a chunk, at least (a document is never cut).
CHUNK_IDS = 1 << 19
#: Entries of a worker's tables before they are started anew; bounds of memory only.
GROUP_BYTES = 1 << 22
WORD_ENTRIES = 100_000
PIECE_ENTRIES = 300_000
#: Up to here every letter is its own NFC form.
LAST_LATIN = "\u024f"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte: itself if it is
    printable and no space, else the next unused one from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


BYTE_LETTERS = _byte_letters()
MAGIC = b"HUF1"


# ---------------------------------------------------------------- tokenizer

class WordIds(dict):
    """Word (bytes between ASCII spaces) to its ids as packed little-endian integers.

    The tokenizer drops white space and cuts at it, so a text's ids are those of its
    words, and a word's those of its pre-tokens, each of which the library encodes
    once while the table holds it. Words with characters beyond Latin letters, or
    with the start of a special string, go to the library whole.
    """

    def __init__(self, tokenizer_path: str, dtype: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_path)
        self.encode_word, self.merge = library.encode, library.model.tokenize
        self.dtype, self.code = dtype, "H" if dtype == "<u2" else "I"
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        self.split = regex.compile(cuts[0]["pattern"]["Regex"]).findall if known else None

    def _packed(self, ids) -> bytes:
        found = array.array(self.code, ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _piece(self, piece: str) -> bytes:
        """A pre-token's ids from the library's model, which takes bytes as printable letters."""
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return self._packed([t.id for t in self.merge(piece)])

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            if self.split is None or "<|" in text or not (text.isascii() or max(text) <= LAST_LATIN):
                found = self._packed(self.encode_word(text, add_special_tokens=False).ids)
            else:
                found, low = b"", text.lower()
                for piece in (low,) if low.isalpha() else self.split(low):  # letters alone are one pre-token
                    ids = self.pieces.get(piece)
                    if ids is None:
                        ids = self.pieces[piece] = self._piece(piece)
                    found += ids
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > WORD_ENTRIES:
            self.older = dict(self)
            self.clear()
        if len(self.pieces) > PIECE_ENTRIES:
            self.pieces.clear()

    def encode(self, text: bytes) -> bytes:
        found = b"".join(map(self.__getitem__, text.split()))
        self.trim()
        return found

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has: words are made
        distinct in Arrow, so each is looked up once, and their ids are gathered."""
        split = pc.ascii_split_whitespace(column.fill_null(""))
        words = split.flatten().dictionary_encode()
        packed = list(map(self.__getitem__, words.dictionary.cast(pa.binary()).to_pylist()))
        self.trim()
        flat = np.frombuffer(b"".join(packed), self.dtype)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // flat.itemsize
        first = np.cumsum(size) - size
        at = words.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        kind = np.int32 if total < 1 << 31 else np.int64
        place = np.repeat((first[at] - (end - n)).astype(kind), n)
        place += np.arange(total, dtype=kind)
        ids = flat[place]
        return ids, np.diff(np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()])


_words: dict[tuple[str, str], WordIds] = common.cache(__name__, {})


def _word_ids(path: str, dtype: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    common.only(__name__)
    if (path, dtype) not in _words:
        _words[path, dtype] = WordIds(path, dtype)
    return _words[path, dtype]


# ------------------------------------------------------------------ codebook

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``max_bits`` bits, or one more than the
    bits that number the symbols (package-merge); 0 for symbols that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        max_bits = (len(used) - 1).bit_length() + 1
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    is_leaf, level = [], weight
    is_leaf.append(np.ones(len(weight), bool))
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < len(weight))
        level = both[order]
    take = 2 * len(used) - 2
    for leaf in reversed(is_leaf):
        leaves = int(leaf[:take].sum())
        lengths[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - last
        at = np.flatnonzero(lengths == n)
        codes[at] = code + np.arange(len(at), dtype=np.uint32)
        code, last = code + len(at), n
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each next bits of the longest code's length: the symbol in the low 24 bits and its
    length above them."""
    max_bits = max(1, int(lengths.max(initial=0)))
    found = np.zeros(1 << max_bits, np.uint32)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (max_bits - lengths[used].astype(np.int64)))
    entries = used.astype(np.uint32) | (lengths[used].astype(np.uint32) << 24)
    filled = np.repeat(entries, spans)
    assert len(used) == 0 or codes[used[0]] == 0
    found[: len(filled)] = filled
    return found


# -------------------------------------------------------------------- blocks

def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    n = len(ids)
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    bits = int(end[-1]) if n else 0
    words = np.zeros((bits >> 6) + 2, np.uint64)
    if n:
        word, shift = start >> 6, 64 - (start & 63) - size
        code = codes[ids].astype(np.uint64)
        over = shift < 0
        here = np.where(over, code >> np.where(over, -shift, 0).astype(np.uint64), code << np.where(over, 0, shift).astype(np.uint64))
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[first]] = np.bitwise_or.reduceat(here, first)
        at = np.flatnonzero(over)
        words[word[at] + 1] |= code[at] << (64 + shift[at]).astype(np.uint64)
    points = start[::block].astype("<u8")
    return MAGIC + struct.pack("<III", n, block, len(points)) + points.tobytes() + words.astype(">u8").tobytes()


def unpack(data: bytes, lookup: np.ndarray, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of a chunk, or of some of its blocks; all blocks advance together."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n, block, count = struct.unpack_from("<III", data, 4)
    points = np.frombuffer(data, "<u8", count, 16).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=16 + 8 * count).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    picked = np.arange(count)[blocks]
    left = np.minimum(n - picked * block, block)
    pos, out = points[picked], np.zeros((block, len(picked)), np.uint32)
    top = len(ahead) - 1
    drop = 33 - len(lookup).bit_length()
    for k in range(block):
        entry = lookup[(ahead[np.minimum(pos >> 3, top)] << (pos & 7).astype(np.uint32)) >> np.uint32(drop)]
        out[k] = entry
        pos += entry >> 24
    ids = (out & np.uint32(0xFFFFFF)).T
    return ids[np.arange(block) < left[:, None]]


# ------------------------------------------------------------------ operator

def _id_type(tokenizer_path: str) -> tuple[str, int]:
    from tokenizers import Tokenizer

    n = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    return ("<u2" if n <= 1 << 16 else "<u4"), n


_CHUNK = "part int, seq int, local_start long, n_ids long, doc_ids array<long>, doc_lens array<int>, data binary"


def _chunk(part, seq, start, n, ids, lens, data) -> list[pa.Array]:
    return [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), pa.array([data], pa.binary())]


def _plain_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Writes chunks of plain ids in ascending doc_id order, and with a task's last chunk
    how often each id occurs in the task: texts are tokenized once."""
    dtype, vocab = _id_type(tokenizer_path)
    size = max(vocab, end_id + 1)
    fields = [f.split()[0] for f in _CHUNK.split(", ")] + ["symbols", "counts"]

    def run(batches):
        words, part, seq, start = _word_ids(tokenizer_path, dtype), TaskContext.get().partitionId(), 0, 0
        total = np.zeros(size, np.int64)
        docs, lens, ids = [], np.zeros(0, np.int64), np.zeros(0, dtype)

        def chunk(docs, lens, ids, last=False):
            total[:] += np.bincount(ids, minlength=size)
            at = np.flatnonzero(total) if last else np.zeros(0, np.int64)
            more = [pa.array([at], pa.list_(pa.int32())), pa.array([total[at]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(_chunk(part, seq, start, len(ids), docs, lens, ids.tobytes()) + more, fields)

        for group in common.groups(batches, GROUP_BYTES):
            found, n = words.encode_all(group.column(1).combine_chunks())
            ended = np.full(len(found) + len(n), end_id, dtype)
            inside = np.ones(len(ended), bool)
            inside[np.cumsum(n + 1) - 1] = False
            ended[inside] = found
            docs, lens, ids = docs + group.column(0).to_pylist(), np.concatenate([lens, n + 1]), np.concatenate([ids, ended])
            end, i, base = np.cumsum(lens), 0, 0
            while (j := int(np.searchsorted(end, base + CHUNK_IDS)) + 1) < len(lens):
                yield chunk(docs[i:j], lens[i:j], ids[base : end[j - 1]])
                seq, start, i, base = seq + 1, start + int(end[j - 1]) - base, j, int(end[j - 1])
            docs, lens, ids = docs[i:], lens[i:], ids[base:]
        if docs:
            yield chunk(docs, lens, ids, True)

    order = F.asc_nulls_first("doc_id"), F.asc("tie")  # rows without id, or of one id, may be many
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    (
        rows.repartitionByRange(common.tasks_for(docs), *order)
        .sortWithinPartitions(*order, F.asc_nulls_first("text"))
        .drop("tie")
        .mapInArrow(run, f"{_CHUNK}, symbols array<int>, counts array<long>")
        .write.option("compression", "zstd")
        .parquet(path)
    )


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> None:
    """Writes the ids of all documents to ``path`` in ascending doc_id order (null ids
    first, equal ids by a hash of the text). An empty table gives an empty codebook and no chunks."""
    spark = docs.sparkSession
    common.prepare(spark)
    dtype, vocab = _id_type(tokenizer_path)
    plain = common.new_path(spark, "plain-ids")
    _plain_ids(docs, tokenizer_path, end_id, plain)
    chunks = spark.read.schema(f"{_CHUNK}, symbols array<int>, counts array<long>").parquet(plain)
    # the driver gets a row per id of the vocabulary at most
    got = chunks.select(F.inline(F.arrays_zip("symbols", "counts"))).groupBy("symbols").agg(F.sum("counts").alias("n")).toArrow()
    counts = np.zeros(max(vocab, end_id + 1), np.int64)
    counts[got["symbols"].to_numpy()] = got["n"].to_numpy()
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "symbol int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # one entry per id of the vocabulary

    def run(batches):
        length, code = book.value
        common.only("files")  # all texts are cut by now: the words go
        for b in batches:
            for row in b.to_pylist():
                row["data"] = pack(np.frombuffer(row["data"], dtype), length, code)
                yield pa.RecordBatch.from_arrays(_chunk(*row.values()), list(row))

    chunks.drop("symbols", "counts").mapInArrow(run, _CHUNK).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    common.delete(spark, plain)


def read_codebook(spark: SparkSession, path: str) -> np.ndarray:
    got = spark.read.parquet(f"{path}/codebook").toArrow()
    lengths = np.zeros(1 + max(got["symbol"].to_pylist(), default=0), np.int64)
    lengths[got["symbol"].to_numpy()] = got["length"].to_numpy()
    return lengths


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; ``with_ids``
    also gives the ids."""
    table = spark.sparkContext.broadcast(decode_table(read_codebook(spark, path)))
    chunks = spark.read.parquet(f"{path}/chunks")
    # one row per part, of which there are as many as the writer had tasks
    totals = dict(chunks.groupBy("part").agg(F.sum("n_ids")).collect())
    begin, at = {}, 0
    for part in sorted(totals):
        begin[part], at = at, at + totals[part]

    def run(batches):
        common.only("files")
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(row["data"], table.value)
                lens = np.array(row["doc_lens"], np.int64)
                end = np.cumsum(lens)
                crc = np.array([zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(end, lens, strict=True)], np.int64)
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array(begin[row["part"]] + row["local_start"] + end - lens), pa.array(lens), pa.array(crc)]
                if with_ids:
                    out.append(pa.array([ids[e - n : e].tolist() for e, n in zip(end, lens, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return chunks.select("part", "local_start", "doc_ids", "doc_lens", "data").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the files, then reads them back."""
    spark = docs.sparkSession
    path = path or common.new_path(spark, "token-files")
    write_ids(docs, tokenizer_path, path, end_id)
    return read_ids(spark, path)
