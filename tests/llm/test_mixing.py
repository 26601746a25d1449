import math
import random
import re
import struct
from collections import defaultdict

import xxhash

from tarnwell.llm import mixing
from tarnwell.llm.mixing import mix, sainte_lague, targets


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(w[s] for s in names if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * w[s] / open_weight for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def brute_seats(weights, n):
    seats = {k: 0 for k in weights}
    for _ in range(n):
        best = max(sorted(weights), key=lambda k: weights[k] / (2 * seats[k] + 1))
        seats[best] += 1
    return seats


def test_targets_and_seats(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 900, 20_000]) for i in range(rng.randrange(2, 9))} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = brute_targets(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)
    weights = {k: float(rng.choice([1, 7, 7, 40, 333])) for k in range(12)}
    for n in (0, 1, 5, 12, 100, 1001):
        df = spark.createDataFrame([(0, k, w, n) for k, w in weights.items()], "g int, k int, w double, n int")
        got = {r.k: r.q for r in sainte_lague(df, ["g"], ["k"], "w", "n", "q").collect()}
        assert got == brute_seats(weights, n)


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 30, 400]), f"s{min(i % 7, 3)}", "x") for i in range(700)]
    rows += [(1000, None, "s1", "x"), (1001, "nur ein", None, "x"), (1002, "a\tb\x0bc\n", None, "x"), (5, "twice a", "s0", "x"), (5, "twice a", "s0", "x"), (None, "no id", "s2", "x"), (1003, "", "tiny", "x"), (1004, "long " * 50_000, "s3", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    for kw in ({}, {"shard_words": 500, "fan_out": 3, "block": 8}):
        got = mix(docs, **kw).collect()
        again = mix(docs.repartition(5), **kw).collect()
        assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
        size = defaultdict(int)
        for _, t, s, _ in rows:
            size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want, taken = brute_targets(size), defaultdict(int)
        for r in got:
            assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        for s in size:
            assert abs(taken[s] - want[s]) <= max(1, 0.01 * want[s]), (s, taken[s], want[s])
    assert mix(docs.limit(0)).count() == 0


def plain_mix(rows, block=32, shard_words=1 << 18, fan_out=1024, seed=17):
    """(doc_id, size, taken) of each row, word by word."""

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
                h = xxhash.xxh64_intdigest(data, h & (2**64 - 1))
        return h - 2**64 if h >= 2**63 else h

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    totals = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    want = brute_targets(totals)
    least = min((t for t in want.values() if t > 0), default=0)
    block = max(1, min(block, math.floor(least / 200)))
    ranks = {s: k for k, s in enumerate(names)}
    seats = brute_seats({ranks[s]: want[s] for s in names}, round_half_up(sum(want.values()) / block)) if any(want.values()) else {}
    taken = [0] * len(rows)
    for s in names:
        shards = defaultdict(list)
        n_shards = max(1, math.ceil(totals[s] / shard_words))
        for i, (d, t, of) in enumerate(rows):
            if of == s:
                order = hashed((seed,), d, size[i], hashed(t))
                shards[hashed(order) % n_shards].append((order, d is None, d or 0, size[i], i))
        words = {k: sum(x[3] for x in v) for k, v in shards.items()}
        n = {k: max(1, round_half_up(w / block)) for k, w in words.items() if w}
        parts = defaultdict(dict)
        for k in n:
            parts[k // fan_out][k] = n[k]
        if not n:
            continue
        of_source = min(seats[ranks[s]], 3 * sum(n.values()))
        of_parts = brute_seats({p: float(sum(v.values())) for p, v in parts.items()}, of_source)
        for p, inner in parts.items():
            of_shards = brute_seats({k: float(v) for k, v in inner.items()}, min(of_parts[p], 3 * sum(inner.values())))
            for k, m in inner.items():
                q = min(of_shards[k], 3 * m)
                start = hashed((seed,), s, (k,), "start") % m
                times = [q // m] * m
                for b in range(q % m):
                    times[(start + b) % m] += 1
                count = [t for b, t in enumerate(times) for _ in range((b + 1) * words[k] // m - b * words[k] // m)]
                at = 0
                for *_, length, i in sorted(shards[k]):
                    taken[i] = sum(count[at : at + length])
                    at += length
    return sorted(((d, n, x) for (d, _, _), n, x in zip(rows, size, taken)), key=str)


def round_half_up(x):
    return math.floor(x + 0.5)


def test_taken_against_plain(spark):
    rng = random.Random(9)
    for trial in range(3):
        rows = [(i if i % 11 else None, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["a", "b", "c", None])) for i in range(rng.choice([3, 40, 150]))]
        rows += [(900, "two words", "tiny"), (901, None, "void"), (902, "", None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        for kw in ({}, {"shard_words": 100, "fan_out": 2, "block": 4}):
            got = sorted(((r.doc_id, r["size"], r.taken) for r in mix(docs, **kw).collect()), key=str)
            assert got == plain_mix(rows, **kw), (trial, kw)


def test_small_sources_get_their_words(spark):
    for total in (10, 100, 1000, 10_000):
        rows = [(1, "w " * 2, "a"), (2, "w " * (total - 2), "b")] if total == 10 else [(i, "w " * (total // 20), f"s{i % 7}") for i in range(20)]
        got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        taken = defaultdict(int)
        for r in got:
            taken[r.source] += r.taken
        for r in got:
            assert abs(taken[r.source] - r.target) <= max(1, 0.01 * r.target), (total, r)


def test_very_many_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MANY", 500)
    rows = [(None, "a b c", "x")] * 3000 + [(None, None, "x")] * 900 + [(7, "one two", "y")] * 600 + [(k, "p q", "z") for k in range(400)] + [(9, "s t", "z")] * 5
    results = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        out = mixing.mix(df, shard_words=256)
        equal = out.where("doc_id IS NULL AND size = 3").groupBy("shard").count().collect()
        assert len(equal) > 20 and max(r["count"] for r in equal) < 400
        assert out.where("doc_id IS NULL AND size = 0").select("shard").distinct().count() > 20
        got = sorted(map(tuple, out.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
        assert len(got) == len(rows) and all(0 <= r[4] <= 3 * r[1] for r in got)
        results.append(got)
    assert results[0] == results[1]
    taken = {s: sum(r[4] for r in results[0] if r[2] == s) for s in {r[2] for r in results[0]}}
    for _, _, source_size, target, _ in results[0]:
        assert abs(taken[source_size] - target) <= 0.05 * target + 2
