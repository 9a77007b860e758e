import random
import re

import numpy as np
import pytest

from ambler.llm import near_dup

from .conftest import EDGE, words


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id to (set size, component) by all pairs."""
    sets = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(text, share, r):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def family(seed, n, size, share):
    r = random.Random(seed)
    base = words(size, seed)
    return [base] + [edited(base, r.uniform(0, share), r) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    texts = [t for s in range(12) for t in family(s, 6, 40 + 20 * s, 0.08)] + [t for s in range(50, 60) for t in family(s, 4, 12, 0.2)]
    texts += ["same text again and again", "Same  text AGAIN and\nagain", "same text again"] * 3 + family(99, 90, 150, 0.09)
    r = random.Random(4)
    passage = words(60, 777)
    texts += [words(25, 1000 + k) + " " + passage + " " + words(25, 2000 + k) for k in range(40)]
    r.shuffle(texts)
    return [(3 * k + 1, t) for k, t in enumerate(texts)]


def check(df, rows):
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}
    assert got == want


def test_links_equal_all_pairs(docs, corpus):
    out = near_dup.link(docs(corpus))
    check(out, corpus)
    assert out.filter("kept != (doc_id = component_id)").count() == 0


def test_one_member_blocks_and_shuffled_ids(docs, corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    check(near_dup.link(docs(corpus)), corpus)


def test_edge_rows(docs):
    got = near_dup.link(docs(EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[None].kept
    assert (by[1].n_shingles, by[1].component_id, by[2].n_shingles, by[3].component_id) == (0, 1, 0, 3)
    assert by[5].component_id == 4 and not by[5].kept and by[4].n_shingles == 1
    assert sum(r.doc_id == 7 and r.kept for r in got) == 2
    assert near_dup.link(docs([])).count() == 0


def test_deduplicate_keeps_one_row_of_a_group(docs):
    out = near_dup.deduplicate(docs(EDGE))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]
    assert out.columns == docs(EDGE).columns


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200)], "a long, b long")
    got = dict(near_dup.components(edges).collect())
    assert got == {k: 0 for k in range(1, 61)} | {200: 100}


def test_signature_of_a_tiny_set_is_filled_and_stable():
    s = near_dup.shingles(b"a b c d e f")
    sig = near_dup.signature(s)
    assert set(sig) <= set(s) and np.array_equal(sig, near_dup.signature(s)) and len(s) == 2


def test_signatures_estimate_similarity():
    r = random.Random(1)
    base = words(800, 5, 10**6)
    x, y = near_dup.shingles(base.encode()), near_dup.shingles(edited(base, 0.03, r).encode())
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((near_dup.signature(x) == near_dup.signature(y)).mean() - true) < 0.15


def test_repeated_ids_are_one_document(docs):
    a, b, c = words(40, 1), words(40, 2), words(40, 3)
    got = near_dup.link(docs([(5, a), (5, b), (3, b), (9, a), (20, c), (21, c), (22, words(30, 4)), (9, c)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), *[(5, 3, False)] * 2, *[(9, 3, False)] * 2, (20, 3, False), (21, 3, False), (22, 22, True)]
    kept = near_dup.deduplicate(docs([(5, a), (5, b), (3, b), (3, a)]).selectExpr("*", "1 AS _place", "2 AS place"))
    assert [r.doc_id for r in kept.collect()] == [3] and kept.columns[-2:] == ["_place", "place"]
