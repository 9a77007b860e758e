import random
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ambler.llm import decontaminate, licenses, queries

from .conftest import EDGE, words

QUESTION = "A train leaves Boston at 60 km per hour and a second train leaves Denver at 45 km per hour, how long until Boston and Denver trains meet?"
CHANGED = "A train leaves Madrid at 80 km per hour and a second train leaves Lisbon at 95 km per hour, how long until Madrid and Lisbon trains meet?"
MIXED_UP = "A train leaves Madrid at 80 km per hour and a second train leaves Lisbon at 95 km per hour, how long until Paris and Lisbon trains meet?"


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def found(df):
    return sorted((r.doc_id, r.item_id, r.reparameterised) for r in df.collect())


def test_exact_changed_and_inconsistent_questions(docs, bench):
    rows = [(1, words(30, 1) + ". " + QUESTION + " " + words(30, 2)), (2, CHANGED), (3, MIXED_UP), (4, words(80, 3)), (5, QUESTION.lower()), (6, " ".join(QUESTION.split()[:6]))]
    got = found(decontaminate.find(docs(rows), bench([(10, QUESTION, "x"), (11, words(40, 55), "x")])))
    assert got == [(1, 10, False), (2, 10, True), (5, 10, False)]


def test_copies_by_brute_force(docs, bench):
    items = [(k, words(15 + k, 9000 + k, 900), "") for k in range(40)]
    r, rows, want = random.Random(0), [], []
    for d in range(150):
        text = words(60, d, 900).split()
        if d % 3 == 0:
            k = r.randrange(40)
            at = r.randrange(60)
            text[at:at] = items[k][1].split()
            want.append((d, k, False))
        rows.append((d, " ".join(text)))
    df = docs(rows)
    assert found(decontaminate.find(df, bench(items))) == want
    clean = decontaminate.clean(df, bench(items))
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, *_ in want}


def test_a_larger_benchmark_is_joined_by_hash(docs, bench, monkeypatch):
    items = [(k, words(20, 9100 + k), "") for k in range(6)] + [(6, QUESTION, ""), (7, "Compute 48 times 12.", ""), (8, words(60, 8, 10**6), "")]
    w = items[8][1].split()
    rows = [(k, items[k][1]) for k in range(6)] + [(6, CHANGED), (7, "so compute 48 times 12 now"), (8, " ".join(w[:20] + ["x"] + w[20:45])), (9, MIXED_UP), (None, QUESTION), (6, CHANGED), *EDGE]
    df = docs(rows).toDF("doc_id", "text", "k", "row", "r", "item_id", "hash", "shape", "theirs")
    want, kept = found(decontaminate.find(docs(rows), bench(items)).fillna(-1)), decontaminate.clean(df, bench(items)).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    assert found(decontaminate.find(df, bench(items)).fillna(-1)) == want and len(want) == 11
    clean = decontaminate.clean(df, bench(items))
    key = lambda r: str(tuple(r))
    assert clean.columns == df.columns and sorted(clean.collect(), key=key) == sorted(kept, key=key)
    assert decontaminate.find(docs([]), bench(items)).count() == 0


def test_short_and_numeric_items(docs, bench):
    items = [(1, "What is 12 + 30 * 7 - 4 ?", ""), (2, "Compute 48 times 12.", ""), (3, "1 2 3 4 5 6 7 8 9 10 11 12", ""), (4, "no no no no no no", ""), (5, "Paris", "")]
    rows = [(1, "So: what is 12 + 30 * 7 - 4 ? I ask"), (2, "one compute 48 times 12. two"), (3, "Compute 7 times 5!"), (4, "count 1 2 3 4 5 6 7 8 9 10 11 12 done"), (5, "count 2 2 3 5 5 6 8 8 9 11 11 12 done")]
    rows += [(6, "oh no no no no no no no"), (7, "to Paris, by train"), (8, "48 times 12 compute"), (9, "what is 12 + 30 * 7"), (10, words(60, 3))]
    got = found(decontaminate.find(docs(rows), bench(items)))
    assert got == [(1, 1, False), (2, 2, False), (3, 2, True), (4, 3, False), (6, 4, False), (7, 5, False)]


def test_half_an_item_counts_a_fragment_does_not(docs, bench):
    w = words(40, 7, 10**6).split()
    rows = [(1, " ".join(w[:22])), (2, " ".join(w[:14])), (3, " ".join(w[5:37]))]
    assert [r[0] for r in found(decontaminate.find(docs(rows), bench([(0, " ".join(w), "")])))] == [1, 3]


def test_copies_with_words_put_in_or_left_out(docs, bench):
    """Windows on several diagonals add up; far from each other, or too few, they don't."""
    w, short = words(60, 8, 10**6).split(), words(18, 9, 10**6).split()
    put = lambda x, *at: " ".join(t for k, y in enumerate(x) for t in (["extra"] * (k in at) + [y]))
    rows = [
        (1, put(w, 15, 30, 45)),
        (2, " ".join(w[:18] + w[20:38] + w[40:])),
        (3, put(short, 6, 12)),
        (4, " ".join(w[:20]) + " " + words(300, 10) + " " + " ".join(w[20:40])),
        (5, " ".join(w[:14] + ["extra"] + w[14:28])),
    ]
    got = decontaminate.find(docs(rows), bench([(0, " ".join(w), ""), (1, " ".join(short), "")]))
    assert found(got) == [(1, 0, False), (2, 0, False), (3, 1, False)]
    assert {r.doc_id: r.coverage for r in got.collect()} == {1: 1.0, 2: 56 / 60, 3: 1.0}


def test_decontamination_edge_rows(docs, bench):
    items = [(1, "very long ü x ü x ü x ü x", ""), (None, "one", ""), (2, None, ""), (3, "one", ""), (4, "twice the same row of text here", "")]
    got = found(decontaminate.find(docs(EDGE), bench(items)))
    assert got == [(4, 3, False), (5, 3, False), (6, 1, False), (7, 4, False), (7, 4, False)]
    assert decontaminate.find(docs([]), bench(items)).count() == 0 and decontaminate.find(docs(EDGE), bench([])).count() == 0
    assert decontaminate.clean(docs(EDGE), bench([])).count() == len(EDGE)


def test_canonical_words():
    word, typed, plain, of = decontaminate.canonical(b"", b"Ann paid Bob 3.50 dollars. Then km of Road", b"5", b"km Of")
    kinds = {int(decontaminate.NUMBER): "N", int(decontaminate.UNIT): "U", int(decontaminate.NAME): "P"}
    assert "".join(kinds.get(int(x), ".") for x in typed) == "..PNU...PN.P"
    assert "".join(kinds.get(int(x), ".") for x in plain) == "...N.....N.."
    assert of.tolist() == [1] * 9 + [2, 3, 3]


# ------------------------------------------------------------------- licences

def scan(df):
    return sorted((r.doc_id, r.license_id, r.first_word, r.n_words, round(r.dice, 3)) for r in df.collect())


def test_notices_and_texts(docs):
    mit = licenses.NOTICES["MIT"][-1]
    rows = [
        (1, words(20, 1) + "\nReleased under the MIT License."),
        (2, "This work is licensed under the GNU General Public License, version 3. " + words(9, 2) + " Licensed under CC BY-NC 4.0."),
        (3, "Copyright 2020\n" + mit.upper().replace(" ", "\n  ")),
        (4, words(50, 3) + " under the license of the house"),
        (5, "licensed under the apache license, version 2.1"),
    ]
    got = scan(licenses.scan(docs(rows)))
    assert [(d, k) for d, k, *_ in got] == [(1, "MIT"), (2, "CC-BY-NC-4.0"), (2, "GPL-3.0"), (3, "MIT"), (5, "Apache-2.0")]
    assert got[0][2:] == (20, 5, 1.0) and got[3][4] == 1.0 and 0.8 <= got[4][4] < 1


def bag(a, b):
    a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_passages_by_brute_force():
    """A licence is named where any passage reaches the coefficient, and what is named has it."""
    r = random.Random(5)
    own = [f"t{k}" for k in range(12)]
    scanner = licenses.Scanner([("t", " ".join(own))], 0.7)
    yes = 0
    for _ in range(400):
        edit = r.choice([0.05, 0.15, 0.3])
        w = ["x", "y", "z"] + [u for t in own for u in r.choice([[t]] * 3 + [[t, "x"], [], ["y"]] if r.random() < 3 * edit else [[t]])] + ["x"] * 3
        best = max(bag(w[a : b + 1], own) for a in range(len(w)) for b in range(a + 1, len(w)))
        got = scanner.scan(" ".join(w).encode())
        assert bool(got) == (best >= 0.7 - 1e-9)
        yes += bool(got)
        for _, d, first, n in got:
            assert d >= 0.7 and d == pytest.approx(bag(w[first : first + n], own))
    assert 50 < yes < 390


def reaches(text, own, least):
    """Whether any passage of a text has the coefficient, by trying all."""
    pair = lambda t: list(zip(t, t[1:], strict=False))
    rows, want = pair(text), Counter(pair(own))
    m = sum(want.values())
    for a in range(len(rows)):
        left, c = want.copy(), 0
        for n, row in enumerate(rows[a:], 1):
            if left[row] > 0:
                left[row] -= 1
                c += 1
            if 2 * c >= least * (n + m) - 1e-9:
                return True
    return False


@pytest.mark.parametrize("vocabulary", [2, 3, 4, 8, 15, 30])
def test_no_passage_is_lost_among_few_different_words(vocabulary):
    """Random texts over a few words repeat a template's bigrams more often than it does."""
    r, letters, yes = random.Random(vocabulary), [f"w{k}" for k in range(vocabulary)], 0
    for _ in range(350):
        own = r.choices(letters, k=r.randint(3, 30))
        text = r.choices(letters, k=r.randint(0, 40))
        for _ in range(r.randint(0, 2)):
            text += [u for u in own if r.random() > 0.1] + r.choices(letters, k=r.randint(0, 12))
        want, got = reaches(text, own, 0.8), licenses.Scanner([("t", " ".join(own))]).scan(" ".join(text).encode())
        assert bool(got) == want, (own, text)
        yes += want
        for _, d, first, n in got:
            assert d >= 0.8 and d == pytest.approx(bag(text[first : first + n], own))
        ends = [(first, first + n - 1) for _, _, first, n in got]  # a word may end one passage and begin the next
        assert all(x <= y for (_, x), (y, _) in zip(ends, ends[1:], strict=False))
    assert 100 < yes


def test_counted_passages_by_brute_force():
    r = np.random.default_rng(4)
    for _ in range(100):
        n, m, d = int(r.integers(1, 60)), int(r.integers(2, 30)), 0.8
        places = np.flatnonzero(r.random(80) < 0.8)[:n]
        earlier = np.array([r.integers(-1, k) if k and r.random() < 0.5 else -1 for k in range(len(places))])
        value = lambda i, j: 2 * int((earlier[i : j + 1] < i).sum()) - d * (places[j] - places[i] + 1)  # noqa: B023, E731
        want = {i: max(value(i, j) for j in range(i, len(places)) if places[j] - places[i] + 1 <= m * (2 - d) / d + 1e-9) for i in range(len(places))}
        want = {i: v for i, v in want.items() if v >= d * m - 1e-9}
        got = licenses.counted_passages(places, earlier, m, d)
        assert sorted(i for i, _ in got) == sorted(want) and all(value(i, j) == pytest.approx(want[i]) for i, j in got)


def test_best_passages_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(100):
        places, m, d = np.flatnonzero(r.random(120) < r.choice([0.2, 0.6, 0.95])), int(r.integers(3, 40)), 0.8
        value = lambda i, j: 2 * (j - i + 1) - d * (places[j] - places[i] + 1)  # noqa: B023, E731
        want = {}
        for j in range(len(places)):
            some = [(value(i, j), -i) for i in range(j + 1) if j - i < m and places[j] - places[i] + 1 <= m * (2 - d) / d]
            if max(some)[0] >= d * m - 1e-9:
                want[j] = max(some)[0]
        got = licenses.best_passages(places, m, d)
        assert {j for _, j in got} == set(want) and all(value(i, j) == pytest.approx(want[j]) for i, j in got)


def test_whole_texts_copies_and_time():
    whole = {n: t for n, t in licenses.templates() if len(t.split()) > 700}
    assert set(whole) == {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    scanner, r = licenses.Scanner(licenses.templates()), random.Random(2)
    for name, text in whole.items():
        edited = " ".join(w if r.random() > 0.04 else "changed" for w in text.split())
        assert [n for n, *_ in scanner.scan((words(40, 1) + " " + edited + " " + words(40, 2)).encode())] == [name]
        assert [n for n, *_ in scanner.scan((text + "\n\n" + text + " " + words(9, 1) + " " + edited).encode())] == [name] * 3
    assert scanner.scan(words(3000, 4).encode()) == [] and scanner.scan(("of the " * 5000).encode()) == []
    own = licenses.Scanner([("t", words(800, 3, 10**6))])
    took = []
    for _ in range(3):
        began = time.perf_counter()
        own.scan(words(800, 3, 10**6).encode())
        took.append(time.perf_counter() - began)
    assert min(took) < 0.05


def test_dice():
    a = lambda *x: np.array(x, np.uint64)
    assert licenses.dice(a(1, 2, 3), a(2, 3, 4)) == pytest.approx(2 / 3) and licenses.dice(a(), a()) == 0.0
    assert licenses.dice(a(1, 1, 2), a(1, 1, 1)) == pytest.approx(2 / 3)


def test_license_edge_rows(docs):
    assert licenses.scan(docs(EDGE)).count() == 0 and licenses.scan(docs([])).count() == 0
    assert licenses.scan(docs(EDGE), []).count() == 0
    got = licenses.scan(docs([(None, "Released under the ISC License."), (3, "Released under the ISC License."), (3, "Released under the ISC License.")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"]


# ------------------------------------------------------------------- pipeline

DATA = "/root/testdata/sf0.001"


def test_pipeline_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns
            docs = corpus_pipeline.common.materialise(out, "test")
            seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3]
    assert out.count() == seen[4]
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.collect()))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
