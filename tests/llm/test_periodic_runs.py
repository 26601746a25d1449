"""Periodic runs against trying every period, planted runs, edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tarnwell.llm import periodic_runs as r


def brute(w, least_times=4, least_words=6):
    n, out = len(w), set()
    for q in range(1, n // least_times + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least_words, least_times * q):
                if not any(all(w[x] == w[x - d] for x in range(start + d, start + length)) for d in range(1, q)):
                    out.add((start, length, q))
            i = max(j, i + 1)
    return sorted(out)


def words(rng):
    n, m = rng.randrange(70), rng.choice([1, 2, 3, 5, 20])
    w = [rng.randrange(m) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a, p, e = rng.randrange(n), 1 + rng.randrange(6), rng.randrange(n + 1)
            w = [w[i] if i < a or i >= e else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return w


def test_runs_equal_all_periods():
    rng = random.Random(13)
    for _ in range(4000):
        w = words(rng)
        assert r.runs(np.array(w, np.int64)) == brute(w), w


def test_squares_are_of_smallest_periods_and_in_every_run():
    rng = random.Random(5)
    for _ in range(400):
        w = words(rng)
        found = set(r.squares(w))
        for period, last in found:
            square = w[last - 2 * period + 1 : last + 1]
            assert square[:period] == square[period:]
            assert not any(all(square[i] == square[i - d] for i in range(d, len(square))) for d in range(1, period))
        for start, length, q in brute(w, 2, 2):
            assert any(p == q and start + 2 * q - 1 <= last < start + length for p, last in found)


def test_places_in_many_buckets(monkeypatch):
    monkeypatch.setattr(r, "BUCKET", 8)
    rng = random.Random(1)
    places, all_of = r.Places(), sorted(rng.sample(range(10_000), 500))
    for x in rng.sample(all_of, len(all_of)):
        places.add(x)
    assert list(places) == all_of and places.size == 500
    for k, x in enumerate(all_of):
        assert places.around(x) == (all_of[k - 1] if k else None, all_of[k + 1] if k + 1 < 500 else None)


@pytest.mark.parametrize(("n", "period"), [(60_000, 1), (60_000, 7), (60_000, 15_000)])
def test_long_runs(n, period):
    rng = random.Random(period)
    w = [rng.randrange(10**6) for _ in range(period)] * (n // period)
    assert r.runs(np.array(w, np.int64)) == [(0, len(w), period)]


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_columns(spark):
    rng = random.Random(8)
    rows = [(None, "a b " * 9), (3, None), (4, ""), (5, "twice twice"), (5, "twice twice"), (6, " \t\n"), (7, "x\x1cy x\xa0y\x85z 🙂 " * 5), (8, "long " * 30_000)]
    rows += [(k, "".join(rng.choice(["a", "b", "é", "dé"]) + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(rng.randrange(90)))) for k in range(100, 400)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, start string, n_runs int")
    got = list(map(tuple, r.digests(docs).collect()))
    small = [(i, t) for i, t in rows if i != 8]
    assert [g for g in got if g[0] != 8] == [plain_row(i, t) for i, t in small]
    assert next(g for g in got if g[0] == 8)[1:5] == (1, 0, 30_000, 1)
    assert any(g[1] for g in got) and any(not g[1] for g in got)
    assert r.digests(docs.limit(0)).count() == 0


def test_find_gives_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "so a b c a b c a b c a b c end"), (2, "no runs here"), (3, None)], "doc_id long, text string")
    got = {x.doc_id: ([tuple(y) for y in x.runs], x.collapsed) for x in r.find(docs).collect()}
    assert got == {1: ([(1, 12, 3)], "so a b c end"), 2: ([], "no runs here"), 3: ([], "")}
