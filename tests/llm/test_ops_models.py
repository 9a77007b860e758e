import random
import re
from collections import Counter

import numpy as np
import pandas
import pytest

from ambler.llm import quality_net, quality_rules, toxicity

from .conftest import EDGE, fold, words

INSULTS = ["zorgblat", "fnordish", "quibblex"]


@pytest.fixture(scope="module")
def judged():
    """(rows, labels): bad texts shout or repeat; toxic ones hold invented insults."""
    r, rows, labels = random.Random(9), [], []
    for i in range(420):
        bad, toxic = i % 6 == 0, i % 4 == 1
        w = words(r.randint(60, 160), i, 3000).split()
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(INSULTS)
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."
        rows.append((i, text))
        if i % 10 != 9:
            labels.append((i, int(not bad), int(toxic), "clash"))
    return rows, labels


def held(got, labels, column):
    return [(r, lab[column]) for r in got for lab in labels if lab[0] == r.doc_id and fold(r.doc_id) == 1]


# ------------------------------------------------------------ quality network

def test_quality_score_by_brute_force(docs, labels, judged):
    """Contexts, vectors, pooled features and the fitted network, a token at a time."""
    rows, known = judged[0][:150], judged[1]
    q = quality_net
    own = {i: q.slots_of(t.encode()).tolist() for i, t in rows}
    index = np.zeros((q.SLOTS, q.DIM))
    for s in {s for x in own.values() for s in x}:
        for at, sign in zip(q._INDEX[s], q._SIGN[s], strict=True):
            index[s, at] += sign
    total = np.zeros((q.SLOTS, q.DIM))
    for x in own.values():
        for k, s in enumerate(x):
            for j in range(max(0, k - q.WINDOW), min(len(x), k + q.WINDOW + 1)):
                if j != k:
                    total[s] += index[x[j]]
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    vectors = np.array([unit(v) for v in total])
    used = np.abs(total).sum(1) > 0
    middle = vectors[used].mean(0)
    vectors[used] = [unit(v - middle) for v in vectors[used]]
    x = {}
    for i, s in own.items():
        v = vectors[s]
        near = sum((v[k] * v[k + 1] for k in range(len(s) - 1)), np.zeros(q.DIM)) / len(s)
        x[i] = np.concatenate([v.mean(0), v.std(0), near, [np.log1p(len(s))]])
    y = {i: good for i, good, *_ in known if i in x and fold(i) != 1}
    ids = sorted(y, key=lambda i: (y[i], *(float(np.float32(c)) for c in x[i][3::-1])))
    network = q.Network(np.array([x[i] for i in ids]), np.array([float(y[i]) for i in ids]))
    got = {r.doc_id: r.score for r in q.score(docs(rows), labels([k for k in known if k[0] in x])).collect()}
    assert set(got) == set(x) and all(got[i] == pytest.approx(float(network(x[i][None])[0]), abs=0.03) for i in x)


def test_network_learns_and_holds_out(docs, labels, judged):
    rows, known = judged
    got = quality_net.score(docs(rows), labels(known)).collect()
    assert len(got) == len(rows) and all(r.held_out == (fold(r.doc_id) == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    right = [r.predicted == y for r, y in held(got, known, 1)]
    assert len(right) > 80 and np.mean(right) > 0.97


def test_network_never_reads_held_out_labels(docs, labels, judged):
    rows, known = judged
    flipped = [(i, 1 - q if fold(i) == 1 else q, t, x) for i, q, t, x in known]
    a = sorted(map(tuple, quality_net.score(docs(rows), labels(known)).collect()))
    b = sorted(map(tuple, quality_net.score(docs(rows).repartition(5), labels(flipped)).collect()))
    assert [r[0] for r in a] == [r[0] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b])


def test_network_edge_rows(docs, labels):
    got = quality_net.score(docs(EDGE), labels([(4, 1, 0, ""), (7, 0, 0, ""), (None, 1, 1, ""), (5, None, None, "")])).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in quality_net.score(docs(EDGE), labels([])).collect()} == {0.5}
    assert quality_net.score(docs([]), labels([])).count() == 0


def test_accept_keeps_rows_and_columns(docs, labels, judged):
    rows, known = judged
    df = docs(rows)
    want = {r.doc_id for r in quality_net.score(df, labels(known)).collect() if r.predicted}
    out = quality_net.accept(df, labels(known))
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == want


def test_context_sums_by_hand():
    a, b, c = 5, 9, 5
    total = quality_net.context_sums([np.array([a, b, c]), np.array([], int), np.array([b])])
    vector = lambda s: np.bincount(quality_net._INDEX[s], quality_net._SIGN[s], quality_net.DIM)
    assert np.allclose(total[b], vector(a) + vector(c))
    assert np.allclose(total[5], 2 * vector(b) + 2 * vector(5))


def test_pools_by_hand_and_in_any_batch(monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(quality_net.SLOTS, quality_net.DIM)).astype(np.float32)
    own = [rng.integers(0, quality_net.SLOTS, n) for n in (3, 0, 1, 40, 7)]
    got = quality_net.pooled(own, v)
    for d, row in zip(own, got, strict=True):
        if len(d):
            x = v[d]
            want = np.concatenate([x.mean(0), x.std(0), (x[:-1] * x[1:]).sum(0) / len(d), [np.log1p(len(d))]])
            assert np.allclose(row, want, atol=1e-4)
        else:
            assert not row.any()
    monkeypatch.setattr(quality_net, "POOL_TOKENS", 4)
    assert np.allclose(quality_net.pooled(own, v), got, atol=1e-5)


def test_temperature_is_fitted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, quality_net.FEATURES))
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = quality_net.Network(x, y)
    assert net.temperature > 1.2  # the labels are noisy, so the weights alone are too sure


# -------------------------------------------------------------- quality rules

def brute_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_base_rules_by_brute_force(docs, labels, judged):
    r = random.Random(2)
    odd = ["".join(r.choice("ab #*<\n\n \t\x0b\x1c\xa0é🙂") for _ in range(r.randint(0, 60))) for _ in range(300)]
    odd += ["a b c a b c", "x x x x", "line\nline\n \n \nline", "\r\na\r\na"]
    rows = EDGE + [(100 + k, t) for k, t in enumerate(odd)]
    got = quality_rules.judge(docs(rows), labels(judged[1])).collect()
    key = lambda r: str(tuple(r))
    want = sorted([(i, *brute_base(t)) for i, t, *_ in rows], key=key)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_ratio_by_brute_force(docs, labels, judged):
    rows, known = judged
    good = {i for i, q, _, _ in known if q == 1 and fold(i) != 1}
    grams = {i: quality_rules.buckets_of(t.encode().split()) for i, t in rows}
    raw, trusted = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(trusted, g, 1)
    p = lambda c: np.log((c + 1) / (c.sum() + len(c)))
    table = p(trusted) - p(raw)
    for r in quality_rules.judge(docs(rows), labels(known)).collect():
        assert r.log_ratio == pytest.approx(table[grams[r.doc_id]].mean())
        assert r.kept == (not r.base_failed and r.log_ratio >= quality_rules.THRESHOLD)


def test_threshold_by_brute_force(spark, docs, labels, judged):
    """Of all cuts between labelled documents of the learning fold, a trusted one scored by
    counts that leave it out, none misjudges less."""
    rows, known = judged
    label = {i: q for i, q, *_ in known if fold(i) != 1}
    grams = {i: quality_rules.buckets_of(t.encode().split()) for i, t in rows}
    total = lambda ids: np.bincount(np.concatenate([grams[i] for i in ids]), minlength=quality_rules.BUCKETS)
    raw, good = total(grams), [i for i, q in label.items() if q]
    trusted = total(good)
    failed = {i for i, t in rows if (w := t.split()) and (len(w) < 50 or 100 * brute_base(t)[3] > 50 * len(w))}
    ratio = {i: quality_rules.log_ratios(raw, total([g for g in good if g != i]))[grams[i]].mean() for i in label if i not in failed}
    for i in good[:5]:
        assert quality_rules.ratio_without(grams[i], raw, trusted) == pytest.approx(ratio[i])
    frame = spark.createDataFrame([(i, q) for i, q in label.items()], "doc_id long, label int")
    cut = quality_rules.fitted_threshold(docs(rows), frame, raw, trusted)
    share = lambda c: np.mean([ratio[i] < c for i in ratio if label[i]]) + np.mean([ratio[i] >= c for i in ratio if not label[i]])
    assert share(cut) == pytest.approx(min(share(c) for c in ratio.values()))
    assert cut == pytest.approx((max(r for r in ratio.values() if r < cut) + min(r for r in ratio.values() if r > cut)) / 2)
    got = {r.doc_id: r for r in quality_rules.judge(docs(rows), labels(known)).collect()}
    assert all(r.kept == (not r.base_failed and r.log_ratio >= cut) for r in got.values())
    turned = [(i, q if fold(i) != 1 else 1 - q, t, c) for i, q, t, c in known]
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs(rows), labels(turned)).collect()} == {i: r.kept for i, r in got.items()}


def test_cuts_of_all_rows_are_those_of_one_array(spark):
    """60,000 labelled rows and small tables with ties, over many ranges; none is left out."""
    rng = np.random.default_rng(3)
    tables = [(np.round(rng.normal(size=n), digits), rng.integers(0, 2, n)) for n, digits in ((1, 1), (2, 1), (9, 0), (40, 1), (40, 6), (300, 2))]
    x = rng.normal(size=60_000)
    tables += [(x, (x + rng.normal(size=60_000) > 0.7).astype(int)), (np.arange(5.0), np.ones(5, int)), (np.array([1.0, 2, 3, 4]), np.array([1, 1, 0, 0]))]
    for ratio, label in tables:
        frame = spark.createDataFrame(pandas.DataFrame({"label": label.astype(np.int32), "ratio": ratio}))
        assert quality_rules.best_cut_of(frame, 7) == quality_rules.best_cut(ratio, label)
    assert quality_rules.best_cut_of(frame.limit(0), 7) is None


def test_best_cuts_by_hand():
    cut = lambda x, y: quality_rules.best_cut(np.array(x, float), np.array(y))
    assert cut([-2, -1, 3, 4], [0, 0, 1, 1]) == 1.0
    assert cut([-2, -1, 0, 3], [0, 1, 0, 1]) == 1.5  # -1.5 misjudges no more, but its gap is narrower
    assert cut([1, 2], [1, 1]) is None and cut([], []) is None and cut([1, 1], [0, 1]) is None and cut([1, 2], [1, 0]) is None
    assert cut([0, 0, 5, 5, 9], [0, 0, 1, 0, 1]) == 2.5


def test_rules_reject_shouting_and_keep_the_clean(docs, labels, judged):
    rows, known = judged
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs(rows), labels(known)).collect()}
    assert np.mean([kept[i] for i, q, *_ in known if q == 1]) > 0.98 and not any(kept[i] for i, q, *_ in known if q == 0)


def test_rules_without_labels(docs, labels):
    got = quality_rules.judge(docs(EDGE), labels([])).collect()
    assert all(r.log_ratio == 0 for r in got) and quality_rules.judge(docs([]), labels([])).count() == 0


# ------------------------------------------------------------------- toxicity

def test_toxicity_holds_out(docs, labels, judged):
    rows, known = judged
    got = toxicity.score(docs(rows), labels(known)).collect()
    assert len(got) == len(rows) and all(r.held_out == (fold(r.doc_id) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    right = [r.predicted == y for r, y in held(got, known, 2)]
    assert len(right) > 80 and np.mean(right) > 0.97


def test_joins_give_what_the_table_gives(docs, labels, judged):
    rows, known = judged
    some = rows[:60] + EDGE[1:]
    a = toxicity.score(docs(some), labels(known)).collect()
    b = toxicity.score(docs(some), labels(known), table_rows=0).collect()
    key = lambda r: (r.doc_id, r.n_words)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert (x.doc_id, x.n_words) == (y.doc_id, y.n_words)
        assert x.gain_per_word == pytest.approx(y.gain_per_word, abs=1e-5) and x.log_ratio_per_word == pytest.approx(y.log_ratio_per_word, abs=1e-3)


def brute_ratios(counts):
    """Ratios by the formulas, over (word, toxic, ordinary) counts, with dictionaries."""
    n, d, m = toxicity.ORDER, toxicity.DISCOUNT, toxicity.SHARED
    c = [Counter(), Counter()]
    for w, *k in counts:
        s = toxicity.PAD * (n - 1) + w + toxicity.END
        for i in range(len(s) - n + 1):
            for j in (0, 1):
                c[j][s[i : i + n]] += k[j]
    grams = [g for g in set(c[0]) | set(c[1])]
    levels, level = {}, set(grams)
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in level)
        level = set(levels[k])

    def lower(g):
        own = {x: v for x, v in levels[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if len(g) == 1:
            return own[g] / total
        return (max(own[g] - d, 0) + d * len(own) * lower(g[1:])) / total

    out = {}
    for h in {g[:-1] for g in grams}:
        own = [g for g in grams if g[:-1] == h]
        total = [sum(x[g] for g in own) for x in c]
        kinds = [sum(x[g] > 0 for g in own) for x in c]
        out[h] = np.log(((d * kinds[0] + m) / (total[0] + m)) / ((d * kinds[1] + m) / (total[1] + m)))
        for g in own:
            shared = (max(c[0][g] + c[1][g] - d, 0) + d * len(own) * lower(g[1:])) / sum(total)
            p = [(max(x[g] - d, 0) + (d * k + m) * shared) / (t + m) for x, k, t in zip(c, kinds, total, strict=True)]
            out[g] = np.log(p[0] / p[1])
    return out


def test_ratios_by_brute_force(spark, docs):
    counts = [("banana", 3, 1), ("band", 0, 7), ("é", 2, 0), ("ananas", 1, 1), ("b", 0, 1)]
    rows = [(" ".join([w] * a), 1) for w, a, _ in counts if a] + [(" ".join([w] * b), 0) for w, _, b in counts if b]
    grams = toxicity.gram_counts(spark.createDataFrame(rows, "text string, label int"))
    got, want = dict(toxicity.ratios(grams).collect()), brute_ratios(counts)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    table = toxicity.ratio_table(toxicity.ratios(grams))
    for w in ("banana", "bandana", "zzz", "é"):
        s, total = toxicity.PAD * (toxicity.ORDER - 1) + w + toxicity.END, 0.0
        for i in range(len(s) - toxicity.ORDER + 1):
            g = s[i : i + toxicity.ORDER]
            total += want.get(g, want.get(g[:-1], 0.0))
        assert toxicity.word_ratios([w], table)[0] == pytest.approx(total, abs=1e-4)


def test_score_by_brute_force(spark, docs, labels):
    """Counts, ratios, length-normalised figures and scores of the whole operator, by dictionaries."""
    r = random.Random(7)
    mild, rude = ["table", "window", "tower", "riverbank", "wonder"], ["grukk", "blargh"]
    rows = [(k, " ".join(r.choice(mild) for _ in range(r.randint(4, 9))) + (" " + r.choice(rude) if k % 4 == 0 else "")) for k in range(260)]
    known = [(k, 1, int(k % 4 == 0), "x") for k in range(0, 260) if k % 7]
    learn = {k: t for k, _, t, _ in known if fold(k) != 1}
    scale = {x.doc_id for x in spark.createDataFrame([(k,) for k in learn], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id, 3), {toxicity.SCALE_PART}) AS s").collect() if x.s == 0}
    text, counts = dict(rows), Counter()
    for k, t in learn.items():
        if k not in scale:
            counts.update((w, t) for w in text[k].split())
    table = brute_ratios([(w, counts[w, 1], counts[w, 0]) for w in {w for w, _ in counts}])

    def ratio(w):
        s = toxicity.PAD * (toxicity.ORDER - 1) + w + toxicity.END
        return sum(table.get(s[i : i + toxicity.ORDER], table.get(s[i : i + toxicity.ORDER - 1], 0.0)) for i in range(len(s) - toxicity.ORDER + 1))

    gain = {z: {k: np.mean([np.log(1 - z + z * np.exp(ratio(w))) for w in t.split()]) for k, t in rows} for z in toxicity.SHARES}
    own, best = sorted(scale), (-np.inf,)
    for z in toxicity.SHARES:
        x = {k: np.log(g - np.log(1 - z) + toxicity.TINY) for k, g in gain[z].items()}
        like, slope, middle, noise = toxicity.fit_scale(np.array([x[k] for k in own]), np.array([learn[k] for k in own]))
        p = {k: noise + (1 - 2 * noise) / (1 + np.exp(-slope * (x[k] - middle))) for k in own}
        assert like == pytest.approx(sum(np.log(p[k] if learn[k] else 1 - p[k]) for k in own), abs=1e-6)
        if like > best[0] + 1e-6:
            best = like, z, slope, middle, x
    _, share, slope, middle, x = best
    gain = gain[share]
    got = toxicity.score(docs(rows), labels(known)).collect()
    assert len(scale) > 4 and {learn[k] for k in own} == {0, 1}
    for d in got:
        assert d.gain_per_word == pytest.approx(gain[d.doc_id], abs=1e-6)
        assert d.score == pytest.approx(1 / (1 + np.exp(-slope * (x[d.doc_id] - middle))), abs=0.02)


@pytest.mark.parametrize("wrong", [0.01, 0.05])
def test_scale_finds_the_curve_of_noisy_labels(wrong):
    r = np.random.default_rng(1)
    x = r.normal(0, 3, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * (x - 1)))).astype(int)
    y = np.where(r.random(4000) < wrong, 1 - y, y)
    _, slope, middle, noise = toxicity.fit_scale(x, y)
    assert slope == pytest.approx(2, rel=0.2) and middle == pytest.approx(1, abs=0.2) and noise in (0.01, 0.02, 0.05, 0.1) and abs(noise - wrong) <= 0.05


@pytest.mark.parametrize("share", [toxicity.SHARES[1], toxicity.SHARES[4]])
def test_model_finds_the_share_that_tells_classes_apart(share):
    """Documents of 400 words: ordinary ones have words of slightly raised ratios, toxic ones a few of high ones."""
    r = np.random.default_rng(5)
    y, n = (np.arange(600) % 3 == 0).astype(int), np.full(600, 400)
    gains = np.zeros((600, len(toxicity.SHARES)))
    for i in range(600):
        ratio = r.normal(-0.5, 1, 400)
        if y[i]:
            high = r.random(400) < max(share, 0.01)
            ratio[high] = r.normal(np.log(3 / share), 0.5, int(high.sum()))
        gains[i] = [toxicity.mixture(ratio, s).sum() for s in toxicity.SHARES]
    found, slope, middle, _ = toxicity.fit_model(gains, n, y)
    like = lambda s: toxicity.fit_scale(toxicity.figure(gains[:, toxicity.SHARES.index(s)], n, s), y)[0]
    assert all(like(found) >= like(s) - 1e-6 for s in toxicity.SHARES)
    right = (slope * (toxicity.figure(gains[:, toxicity.SHARES.index(found)], n, found) - middle) > 0) == (y == 1)
    assert right.mean() > 0.95


def test_held_out_labels_change_nothing(docs, labels, judged):
    rows, known = judged
    turned = [(i, g, 1 - t if fold(i) == 1 else t, x) for i, g, t, x in known]
    read = lambda k: {r.doc_id: r.score for r in toxicity.score(docs(rows), labels(k)).collect()}
    assert turned != known and read(known) == pytest.approx(read(turned), abs=1e-9)


def test_toxicity_edge_rows(docs, labels, judged):
    got = toxicity.score(docs(EDGE), labels(judged[1])).collect()
    assert len(got) == len(EDGE) and all(r.gain_per_word == 0 for r in got if r.doc_id in (1, 2, 3))
    none = toxicity.score(docs(EDGE), labels([])).collect()
    assert all(r.score < 1e-6 and r.predicted == 0 for r in none)
    assert toxicity.score(docs([]), labels([])).count() == 0
