"""Token counts without token ids.

1. The text is cut into the tokenizer's own pre-tokens; a special string is a piece of its
   own. Pre-tokens are counted over the whole table.
2. Every distinct pre-token is encoded by the library once, which gives its number of
   tokens. No ids are kept.
3. Each document's pre-token frequencies are joined to that table, and summed.

Frequencies of a document leave the task that cut it only as sums: the most frequent
pre-tokens, ``HEAVY`` at most, are broadcast, and sums over them combine before the
shuffle. Pre-tokens beyond those, the rare ones, are joined by a shuffle of their pairs.
What is frequent is read off a histogram of the counts, so that no task sorts pre-tokens.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct pre-tokens that are broadcast with their token counts, at most.
HEAVY = 200_000
#: Cells of the histogram for each doubling of a count.
CELLS = 16
#: Entries a worker keeps before it starts its tables anew. A bound of memory, not of work.
TABLE_ENTRIES = 200_000
#: Bytes of text that are cut together, about; a longer text is cut alone. More at once give fewer
#: pieces to count; the pairs of documents and pieces stay as many, and meet the broadcast table.
GROUP_BYTES, PAIR_BYTES = 4 << 20, 2 << 20

# Unicode's White_Space characters, which the tokenizer's \s matches.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A space inside or at the end of white space: the pattern keeps it with what is before it.
ODD = f"[{WHITE_SPACE}] (?:[{WHITE_SPACE}]|$)"

#: Signs that are a pre-token of their own behind a word.
TAILS = ".,;:!?"

#: Spaces and what follows them: no pre-token goes from a non-space to a space.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


class PreTokens(dict):
    """Cuts texts into pre-tokens and special strings. Kept entries: chunk to its pieces.

    Texts are cut before each space, in Arrow, unless a run of white space goes on around
    one (``ODD``); words are made distinct, and those of letters alone, or with one sign behind, are pre-tokens as they
    are. All else goes through the tokenizer's pattern.
    """

    def __init__(self, tokenizer_path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        added = Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values()
        self.names = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.names))) if self.names else None

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        found = self[chunk] = tuple(self.split(chunk))
        return found

    def pieces(self, text: str) -> Counter:
        """The pieces of any text, each with its frequency."""
        chunks, found = Counter(), Counter()
        if self.special is not None and self.special.search(text):
            for part in self.special.split(text):
                chunks.update(CHUNK.findall(part))
            found.update(self.special.findall(text))
        else:
            chunks.update(CHUNK.findall(text))
        for chunk, n in chunks.items():
            for piece in self[chunk]:
                found[piece] += n
        return found

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(text, piece, times) arrays, and the pieces they point to, in which one may occur twice."""
        if len(self) > TABLE_ENTRIES:
            self.clear()
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        for name in self.names:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        words = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        start = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        known, n = coded.dictionary, len(coded.dictionary)
        code = coded.indices.to_numpy().astype(np.int64) + n
        code[start[:-1]] -= n  # a text's first word has no space before it
        text = np.repeat(np.arange(len(texts)), np.diff(start))
        pair, times = np.unique(text * (2 * n) + code, return_counts=True)
        text, code = np.divmod(pair, max(2 * n, 1))
        used, code = np.unique(code, return_inverse=True)
        chunk = known.take(pa.array(used % max(n, 1)))
        chunk = pc.if_else(pa.array(used >= n), pc.binary_join_element_wise(" ", chunk, ""), chunk)
        stem = pc.utf8_rtrim(known, TAILS)
        letters, cut_off = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False), pc.subtract(pc.utf8_length(known), pc.utf8_length(stem)).to_numpy()
        kind = np.where(letters & (cut_off < 2), cut_off, 2)[used % n] if n else np.zeros(0, np.int64)
        plain, tailed, rest = (np.flatnonzero(kind == k) for k in range(3))
        lists = [self[c] for c in chunk.take(pa.array(rest)).to_pylist()]
        size = np.array([1, 2, 0])[kind]
        size[rest] = [len(own) for own in lists]
        first = np.cumsum(size) - size
        order = np.zeros(int(size.sum()), np.int64)  # places of pieces: of plain chunks, of tailed ones and their tails, of the others
        many = len(plain) + 2 * len(tailed)
        order[first[plain]] = np.arange(len(plain))
        order[first[tailed]] = len(plain) + np.arange(len(tailed))
        order[first[tailed] + 1] = len(plain) + len(tailed) + np.arange(len(tailed))
        own = size[rest]
        within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        order[np.repeat(first[rest], own) + within] = many + np.arange(len(within))
        many += len(within)
        ends = chunk.take(pa.array(tailed))
        found = [chunk.take(pa.array(plain)), pc.utf8_slice_codeunits(ends, 0, -1), pc.utf8_slice_codeunits(ends, -1), pa.array([p for own in lists for p in own], pa.string())]
        n_of = size[code]
        end = np.cumsum(n_of)
        at = np.repeat(first[code] - (end - n_of), n_of) + np.arange(int(end[-1]) if len(end) else 0)
        text, piece, times = np.repeat(text, n_of), order[at], np.repeat(times, n_of)
        slow = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(slow):
            own = [self.pieces(t) for t in texts.take(pa.array(slow)).to_pylist()]
            count = np.array([len(c) for c in own], np.int64)
            found.append(pa.array([p for c in own for p in c], pa.string()))
            text = np.concatenate([text, np.repeat(slow, count)])
            piece = np.concatenate([piece, many + np.arange(int(count.sum()))])
            times = np.concatenate([times, np.array([k for c in own for k in c.values()], np.int64)])
        return text, piece, times, pa.concat_arrays(found)


_tables: dict[str, PreTokens] = common.cache(__name__, {})


def _pre_tokens(path: str) -> PreTokens:
    common.only(__name__)
    if path not in _tables:
        _tables[path] = PreTokens(path)
    return _tables[path]


def piece_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(piece, n): how often each pre-token occurs in the table."""

    def run(batches):
        table = _pre_tokens(tokenizer_path)
        for group in common.groups(batches, GROUP_BYTES):
            _, piece, times, names = table.cut(group.column(0).combine_chunks())
            n = np.bincount(piece, times, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(n)], ["piece", "n"])

    return docs.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def token_table(pieces: DataFrame, tokenizer_path: str) -> DataFrame:
    """(piece, n, tokens) of distinct pieces: the library encodes each of them once."""

    def run(batches):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_file(tokenizer_path)
        for b in batches:
            tokens = [len(e) for e in library.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int32())], ["piece", "n", "tokens"])

    return pieces.mapInArrow(run, "piece string, n long, tokens int")


def frequencies(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(row, doc_id, n_bytes, piece, times): the pieces of each row, and the empty piece, 0
    times, so that every row has one. ``row`` tells rows with equal ids apart."""

    def run(batches):
        table = _pre_tokens(tokenizer_path)
        for group in common.groups(batches, PAIR_BYTES):
            texts = group.column(2).combine_chunks()
            text, piece, times, names = table.cut(texts)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            # the empty piece once for each row
            at = pa.array(np.concatenate([text, np.arange(len(texts))]))
            names = pa.concat_arrays([names.take(pa.array(piece)), pa.array([""] * len(texts), pa.string())])
            times = pa.array(np.concatenate([times, np.zeros(len(texts), np.int64)]))
            yield pa.RecordBatch.from_arrays([group.column(0).combine_chunks().take(at), group.column(1).combine_chunks().take(at), size.take(at), names, times], ["row", "doc_id", "n_bytes", "piece", "times"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(run, "row long, doc_id long, n_bytes long, piece string, times long")


def frequent(table: DataFrame, heavy: int) -> DataFrame:
    """The rows of ``table`` whose ``n`` is at least a bound that ``heavy`` rows at most reach. The
    histogram has ``CELLS`` cells for each doubling, some thousand in all."""
    cell = F.floor(F.log2("n") * CELLS)
    rows, bound = 0, 1 << 16  # above any cell
    for c, n in sorted(table.groupBy(cell.alias("cell")).count().collect(), reverse=True):
        rows += n
        if rows > heavy:
            break
        bound = c
    return table.filter(cell >= bound)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    A null or empty text has 0 bytes and 0 tokens. Special strings inside a text
    count as the one token the library makes of them. Rows that repeat, or share a
    doc_id, are counted one by one; a null doc_id stays null.
    """
    common.prepare(docs.sparkSession)
    table = common.materialise(token_table(piece_counts(docs, tokenizer_path), tokenizer_path), "pieces")
    distinct = table.count()
    first = table if distinct <= heavy else frequent(table, heavy)
    first = F.broadcast(first.select("piece", "tokens"))  # ``heavy`` rows at most
    joined = frequencies(docs, tokenizer_path).join(first, "piece", "left")
    row = ["row", "doc_id", "n_bytes"]
    # the empty piece, which each row has, is in no table and counts 0
    sums = joined.filter("tokens IS NOT NULL OR times = 0").select(*row, (F.col("times") * F.coalesce("tokens", F.lit(0))).alias("t"))
    if distinct > heavy:
        rest = joined.filter("tokens IS NULL AND times > 0").select(*row, "piece", "times")
        sums = sums.unionByName(rest.join(table.select("piece", "tokens").hint("shuffle_merge"), "piece").select(*row, (F.col("times") * F.col("tokens")).alias("t")))
    return sums.groupBy(*row).agg(F.sum("t").alias("n_tokens")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
