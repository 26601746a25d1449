import random

import numpy as np

from tarnwell.llm.embedding_dedup import Tile, near_duplicates, quantise, tile_links


def brute(rows, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    n = len(rows)
    link = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold for j in range(n)] for i in range(n)]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if link[i][j]:
                root[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids) if ids else None
        if not ok[i]:
            comp = rows[i][0]
        out.append((rows[i][0], sum(link[i]), comp, None if comp is None or rows[i][0] is None else rows[i][0] == comp))
    return out


def sample(seed=1, n=120, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        rows.append((1000 - i, v.astype(np.float32).tolist()))
        for _ in range(rng.integers(0, 3)):
            noise = v + rng.normal(scale=rng.choice([0.05, 0.25, 0.33]), size=dim)
            rows.append((2000 + len(rows), noise.astype(np.float32).tolist()))
    hub = rng.normal(size=dim)
    rows += [(3000 + i, (hub + rng.normal(scale=0.12, size=dim)).astype(np.float32).tolist()) for i in range(60)]
    rows += [(4000 + i, rows[5][1]) for i in range(30)] + [(4100, [2 * x for x in rows[5][1]])]
    return rows


EDGES = [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0] * 15 + [None]), (5, [1.0] * 15 + [float("nan")]), (6, [float("inf")] + [1.0] * 15), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [3.0] + [0.0] * 15), (9, [3.0] + [0.0] * 15), (9, [3.0] + [0.0] * 15), (None, None)]


def test_against_brute_force(spark):
    rows = sample() + EDGES
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, component_id string, node int")
    want = sorted(brute(rows, 0.95), key=str)
    for tile in (4096, 40, 3):  # one tile, one group a tile, groups of several tiles
        assert sorted(map(tuple, near_duplicates(df, tile=tile).collect()), key=str) == want
    assert near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(1, None)], df.schema["vec_id"].name + " long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


def test_bounds_hold_and_few_pairs_are_checked():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(scale=0.33, size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = quantise(x)
    guess = (codes.astype(float) @ codes.astype(float).T) * scale[:, None] * scale
    assert (np.abs(guess - x @ x.T) <= error[:, None] * (1 + error) + error + 1e-9).all()
    found, checked = set(), 0
    for i, j, _, n in tile_links(Tile.of(x), None, 0.95, strip=64):
        found |= set(zip(i.tolist(), j.tolist()))
        checked += n
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if x[i] @ x[j] >= 0.95}
    assert found == want and checked < 400
