import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ambler.llm import mixing, sharding

from .conftest import EDGE, words


@pytest.fixture(scope="module")
def many():
    rows = [(k, words(5 + k % 90, k), ("b", "a", "c", None, "é")[k % 5 if k % 3 else 0]) for k in range(600)]
    return rows + [(1000 + k, "the same copy " * 9, "a") for k in range(250)]


def sizes(rows):
    return [len((t or "").encode()) + 1 for _, t, *_ in rows]


# ---------------------------------------------------------------- sharding

def test_shards(docs, many):
    got = sharding.shard(docs(many), 16).collect()
    texts = {i: t for i, t, _ in many}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    load, places = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(got) == len(many) and set(load) == set(range(16)) and max(load.values()) - min(load.values()) <= 0.01 * max(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_shards_by_brute_force(spark, docs, many):
    """Every shard and slot, from slots, spread groups and the edited map in plain Python."""
    shards = 16
    text = {i: t for i, t, _ in many}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    found = df.selectExpr("doc_id", "xxhash64(text, 11) AS c", "pmod(xxhash64(doc_id, xxhash64(text, 11)), 4096) AS own", "pmod(xxhash64(text, 11), 4096) AS same", "xxhash64(doc_id, CAST(octet_length(text) + 1 AS LONG)) AS h").collect()
    size = {i: len(t.encode()) + 1 for i, t in text.items()}
    group = Counter()
    for r in found:
        group[r.c] += size[r.doc_id]
    fair = sharding.SPREAD_ABOVE * sum(size.values()) / shards
    slot = {r.doc_id: r.own if group[r.c] > fair else r.same for r in found}
    load, n = np.zeros(4096), Counter(slot.values())
    for i, s in slot.items():
        load[s] += size[i]
    owner = sharding.SlotMap.initial(shards).rebalanced(load).shard_of
    piece = {r.doc_id: r.h % -(-n[slot[r.doc_id]] // sharding.PIECE_ROWS) for r in found}
    at, want = Counter(), {}
    for i in sorted(text, key=lambda i: (slot[i], piece[i], i)):
        want[i] = (owner[slot[i]], at[owner[slot[i]]])
        at[owner[slot[i]]] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs(many), shards).collect()} == want


def test_copies_share_a_shard_unless_too_many(docs, many):
    got = sharding.shard(docs(many[:620]), 4).collect()
    at = defaultdict(set)
    for r in got:
        at[r.text_crc32].add(r.shard)
    assert max(map(len, at.values())) == 1
    hot = sharding.shard(docs(many), 16).filter("doc_id >= 1000")
    assert hot.select("shard").distinct().count() == 16


def test_shard_edge_rows(docs):
    got = sharding.shard(docs(EDGE), 3).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), n) for (i, *_), n in zip(EDGE, sizes(EDGE), strict=True))
    assert sharding.shard(docs([]), 3).count() == 0


def test_small_pieces_number_the_same_rows(docs, many, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 1)
    got = sharding.shard(docs(many), 5).collect()
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_map_versions(spark, tmp_path):
    rng = np.random.default_rng(2)
    size = rng.integers(0, 1000, 256)
    first = sharding.SlotMap.initial(8, 256)
    second = first.rebalanced(size)
    load = np.bincount(second.shard_of, size, 8)
    assert second.version == 2 and load.max() - load.min() <= 0.01 * load.mean() + 5
    third = second.grown(size)
    moved = [(a, b) for a, b in zip(second.shard_of, third.shard_of, strict=True) if a != b]
    assert moved and {b for _, b in moved} == {8}
    assert np.bincount(third.shard_of, size, 9)[8] > 0.9 * size.sum() / 9
    sharding.save_map(spark, str(tmp_path / "map"), [first, second, third])
    assert [r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 2).orderBy("vslot").collect()] == list(second.shard_of)


def test_rebalancing_edits_few_slots():
    size = np.full(64, 100)
    size[0] = 300
    first = sharding.SlotMap.initial(4, 64)
    again = first.rebalanced(size)
    assert sum(a != b for a, b in zip(first.shard_of, again.shard_of, strict=True)) <= 3
    assert again.rebalanced(size).shard_of == again.shard_of


# ------------------------------------------------------------------- mixing

def fill(sizes, weights, share=1.5, most=2):
    left, active, targets = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > most * sizes[i]]
        for i in over or active:
            targets[i] = float(most * sizes[i]) if over else left * weights[i] / total
        left -= sum(most * sizes[i] for i in over)
        active = [i for i in active if i not in over] if over else []
    return targets


def test_fill_shares_the_excess(spark):
    r = np.random.default_rng(4)
    cases = [([100, 100, 100], [5, 2, 1]), ([10, 1000], [5, 2]), ([0, 0], [5, 2])]
    cases += [(r.integers(0, 10 ** int(r.integers(1, 6)), n).tolist(), [(5, 2, 1)[k % 3] for k in range(n)]) for n in r.integers(1, 30, 8)]
    for sizes, weights in cases:
        df = spark.createDataFrame(list(zip(sizes, weights, strict=True)), "words long, weight int")
        got = sorted((x.words, x.weight, x.target) for x in mixing.fill(df).collect())
        want = sorted(zip(sizes, weights, fill(sizes, weights), strict=True))
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert fill([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.fill(spark.createDataFrame([], "words long, weight int")).count() == 0


def highest_quotients(targets, seats):
    got = [0] * len(targets)
    for _ in range(seats if any(targets) else 0):
        k = max(range(len(targets)), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_seats_by_highest_quotients(spark):
    """Unequal weights too, for which rounded shares are off by more than one seat."""
    r, rows, want = random.Random(1), [], {}
    groups = [([1049] + [110] * 15, 27), ([5, 5, 5, 5], 2), ([0, 0], 3), ([3], 7), ([1.5, 0.2, 9.0], 0)]
    groups += [([r.choice([0, r.randint(1, 20), r.randint(1, 3000)]) for _ in range(r.randint(1, 9))], r.randint(0, 80)) for _ in range(150)]
    for g, (weights, seats) in enumerate(groups):
        rows += [(g, k, float(w), seats) for k, w in enumerate(weights)]
        want |= {(g, k): q for k, q in enumerate(highest_quotients(weights, seats))}
    got = mixing.apportion(spark.createDataFrame(rows, "g int, k int, w double, s long"), "g", "k", "w", "s").collect()
    assert {(x.g, x.k): x.q for x in got} == want and want[0, 0] == 12


def mix_check(got, rows):
    own = defaultdict(int)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in rows:
        own[s] += n(t)
    names = sorted((s for s in own if s is not None)) + [None] * (None in own)
    want = dict(zip(names, fill([own[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, r.target) == (own[s], pytest.approx(want[s])) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 1


def brute_taken(spark, rows, seed, shard_words, shard_rows):
    """doc_id to words taken: sources, shards, quotas and streams one after another."""
    n = {i: len((t or "").split()) for i, t, _ in rows}
    of = defaultdict(list)
    for i, _, s in rows:
        of[s].append(i)
    names = sorted(s for s in of if s is not None) + [None] * (None in of)
    words = [sum(n[i] for i in of[s]) for s in names]
    targets = fill(words, [(5, 2, 1)[k % 3] for k in range(len(names))])
    blocks = highest_quotients(targets, round(sum(targets) / 64))
    df = spark.createDataFrame(list(n.items()), "doc_id long, size long")
    hashes = {r.doc_id: (r.a, r.b) for r in df.selectExpr("doc_id", f"xxhash64(doc_id, size, {seed}) AS a", f"xxhash64({seed}, doc_id) AS b").collect()}
    shards, out = {}, {}
    for k, s in enumerate(names):
        count = max(1, -(-words[k] // shard_words), -(-len(of[s]) // shard_rows))
        for i in of[s]:
            shards.setdefault((k, hashes[i][0] % count), []).append(i)
    order = spark.createDataFrame([(k, j, b) for (k, j), own in shards.items() for b in range(sum(n[i] for i in own) // 64 + 1)], "sid long, shard int, block long")
    drawn = {(r.sid, r.shard, r.block): r.h for r in order.selectExpr("*", f"xxhash64({seed}, sid, shard, block) AS h").collect()}
    for k in range(len(names)):
        keys = sorted(j for kk, j in shards if kk == k)
        w = [sum(n[i] for i in shards[k, j]) for j in keys]
        base = [min(64 * q, 2 * x) for q, x in zip(highest_quotients(w, blocks[k]), w, strict=True)]
        rest = int(np.floor(targets[k] + 0.5)) - sum(base)
        own = [2 * x - y for x, y in zip(w, base, strict=True)] if rest >= 0 else base
        end = np.cumsum(own)
        upto = [0] + [int(abs(rest) * (e / end[-1])) if end[-1] else 0 for e in end]
        for t, j in enumerate(keys):
            share = own[t] if abs(rest) >= end[-1] else upto[t + 1] - upto[t]
            quota = base[t] + (share if rest >= 0 else -share)
            stream = [i for i in sorted(shards[k, j], key=lambda i: (hashes[i][1], i)) for _ in range(n[i])]
            times = Counter(stream * (quota // w[t] if w[t] else 0))
            left = quota % w[t] if w[t] else 0
            for b in sorted(range(-(-len(stream) // 64)), key=lambda b: drawn[k, j, b]):
                part = stream[64 * b : 64 * b + 64][: max(left, 0)]
                times.update(part)
                left -= len(part)
            out |= {i: times[i] for i in shards[k, j]}
    return out


def test_mix_meets_its_targets(spark, docs, many, monkeypatch):
    for shard_words, shard_rows in ((mixing.SHARD_WORDS, mixing.SHARD_ROWS), (700, 20)):
        monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
        monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
        got = mixing.mix(docs(many)).collect()
        mix_check(got, many)
        assert {r.doc_id: r.taken for r in got} == brute_taken(spark, many, 17, shard_words, shard_rows)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "PIECE", 2)
    mix_check(mixing.mix(docs(many)).collect(), many)


def test_mix_reruns_agree_whatever_the_partitions(docs, many):
    a = sorted(map(tuple, mixing.mix(docs(many)).collect()))
    assert a == sorted(map(tuple, mixing.mix(docs(many).repartition(9, "text")).collect()))
    b = sorted(map(tuple, mixing.mix(docs(many), seed=18).collect()))
    assert a != b


def test_mix_edge_rows(docs):
    got = mixing.mix(docs(EDGE)).collect()
    assert len(got) == len(EDGE)
    assert all(r.taken == 0 for r in got if r.size == 0) and sum(r.size == 0 for r in got) == 3
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mixed(docs([])).count() == 0


def test_mixed_repeats_rows(docs, many):
    out = mixing.mixed(docs(many))
    assert out.columns == docs(many).columns
    times = Counter(r.doc_id for r in out.collect())
    takes = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs(many)).collect()}
    assert all(taken // size <= times.get(i, 0) <= -(-taken // size) for i, (taken, size) in takes.items())


def test_mixed_with_clashing_columns(docs, many):
    some = [*many[:40], *many[:5], *EDGE]
    plain = docs(some).select("doc_id", "text", "source")
    odd = ["_copy", "_times", "_id", "own_id", "many", "copy", "i", "sid", "q", "words", "target"]
    df = plain.selectExpr("*", *[f"99 AS `{c}`" for c in odd])
    key = lambda r: str(tuple(r))
    got = mixing.mixed(df)
    assert got.columns == df.columns and all(r["_copy"] == r["copy"] == 99 for r in got.collect())
    assert sorted(got.select("doc_id", "text", "source").collect(), key=key) == sorted(mixing.mixed(plain).collect(), key=key)
    assert {r.doc_id for r in got.collect()} >= {1, 2, 3}
