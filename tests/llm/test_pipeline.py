"""The pipeline's rows on a planted corpus, against its five stages in plain Python."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ambler.llm import mixing, quality_net

from .conftest import words
from .test_ops_dedup import brute as groups
from .test_ops_layout import brute_taken

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: shouting junk, copies, near copies, benchmark items, empty texts."""
    r, items = random.Random(3), [(k, words(18, 70_000 + k, 10**6)) for k in range(12)]
    rows, labels = [], []
    for i in range(260):
        bad, text = i % 6 == 0, words(r.randint(40, 120), i, 3000)
        if bad:
            text = " ".join(x.upper() + "!!" for x in text.split())
        elif i % 13 == 1:
            text = text + ". " + items[i % 12][1] + " " + words(20, 9000 + i)
        rows.append((i, text, None if i % 50 == 7 else "en", (f"s{i % 4}", None)[i % 11 == 3], len(text)))
        if i % 5:
            labels.append((i, int(not bad), 0))
    for k in range(40):  # exact copies, and copies with one word changed
        text = rows[7 * (k % 9) + 2][1]
        w = text.split()
        if k % 2:
            w[len(w) // 2] = f"new{k}"
        rows.append((1000 + k, " ".join(w), "en", "s1", len(text)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (2002, " \n", "en", "s0", 2)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_pipeline_by_brute_force(spark, corpus):
    path, rows, items = corpus
    # 1: what the network accepts (its score has tests of its own), which is what is good
    scores = quality_net.score(spark.createDataFrame(rows, COLUMNS), spark.read.parquet(f"{path}/labels.parquet"))
    good = {r.doc_id for r in scores.collect() if r.score >= 0.5}
    assert all((i in good) == (i % 6 != 0) for i, *_ in rows if i < 260)
    rows = [r for r in rows if r[0] in good]
    # 2: the smallest id of each group of all pairs' links; rows without words stay
    group = groups(rows)
    rows = [r for r in rows if group[r[0]][1] == r[0]]
    # 3: no item's words in a row
    rows = [r for r in rows if not any(f" {t} " in f" {' '.join((r[1] or '').replace('.', ' ').split())} " for _, t in items)]
    # 4: whole times, and one more by a draw
    taken = brute_taken(spark, [(i, t, s) for i, t, _, s, _ in rows], 17, mixing.SHARD_WORDS, mixing.SHARD_ROWS)
    draw = {r.doc_id: r.u for r in spark.createDataFrame([(i,) for i, *_ in rows], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 17), 1048576) / 1048576D AS u").collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    copies = {i: int(np.floor(taken[i] / size[i] + draw[i])) if size[i] else 1 for i in size}
    # 5: ids of all documents in order, and one end id each
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t, *_ in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, path).collect())
    assert len(want) > 150 and max(Counter(i for i, *_ in want).values()) == 2
    assert got == want
