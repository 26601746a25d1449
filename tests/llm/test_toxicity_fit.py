"""The fit goes through all labelled rows: chunks, their gradients and averages, cut-offs from all counts."""

import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tarnwell.llm import toxicity as T


def test_buckets_against_single_hashes():
    rng = random.Random(4)
    plain = ["".join(rng.choices("abcé漢🙂\udc80_", k=rng.randrange(14))) for _ in range(2000)] + ["", "a", "\0", "a\0b"]
    want = [[xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % T.BUCKETS, *(xxhash.xxh64_intdigest(w[:k].encode("utf-8", "surrogatepass"), 1) % T.BUCKETS if k < len(w) else T.BUCKETS for k in T.STEMS)] for w in plain]
    assert T.word_buckets(plain).tolist() == want


def test_batch_gradients_are_sums_of_single_ones(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["stone", "Steinwege,", "piedra!", "a", "of", "abcdefghijkl"], k=k)) for k in (0, 1, 2, 5, 40)]
    labels = [0, 1, 0, 1, 1]
    chunk, state, weights = T.chunk_of(texts, labels, [False] * 5), T.State.new(3), (0.6, 3.0)
    model = state.model()
    dense, tables = np.zeros_like(state.dense), np.zeros((T.FIRST_DENSE + 1, T.DIM))
    filters, biases, out = T.State.parts(dense)
    for i, label in enumerate(labels):
        buckets = chunk.buckets[chunk.text(i)]
        x = np.concatenate([model.vectors(buckets), np.zeros((2, 2 * T.DIM), np.float32)])
        _, found, grown = T.loss_gradients(model, x, label, weights[label])
        for k in range(len(T.WIDTHS)):
            filters[k] += found[f"f{k}"]
            biases[k * T.FILTERS : (k + 1) * T.FILTERS] += found[f"b{k}"]
        out[:-1] += found["out"]
        out[-1] += found["bias"]
        for row, g in zip(buckets, grown):
            tables[row[0]] += g[: T.DIM]
            for stem in row[1:]:
                if stem < T.BUCKETS:
                    tables[T.BUCKETS + stem] += g[T.DIM :]
    for piece in (T.PIECE, 7, 1):
        monkeypatch.setattr(T, "PIECE", piece)
        got, rows, grown = T.batch_gradients(state, chunk, list(range(5)), weights)
        mine = np.zeros_like(tables)
        mine[rows] = grown
        assert len(set(rows.tolist())) == len(rows)
        assert np.allclose(got, dense, atol=1e-4) and np.allclose(mine, tables, atol=1e-4)


def test_cut_off_counts_every_text():
    z, count, toxic = np.array([-3.5, -1.5, 0.5, 2.5]), np.array([900, 50, 10, 40]), np.array([0, 5, 10, 40])
    assert T.best_cut(z, count, toxic) == -0.5
    assert T.cut_offs(np.zeros(4, int), z, count, toxic).tolist() == [-0.5] * (len(T.LANGUAGES) + 1)
    assert not T.cut_offs(np.zeros(1, int), z[:1], count[:1], toxic[:1]).any()


def test_fit_sees_every_labelled_row(spark, monkeypatch):
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("lo", "mi", "ta", "ren", "su") for b in ("ka", "ve", "dor", "lin", "pu")]
    place = {r.id: r.place for r in spark.range(6000).select("id", F.xxhash64("id").alias("place")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    toxic = sorted((i for i in place if i % 2), key=place.get)
    # The word of the toxic rows beyond the first 1,500 of their order is found in no earlier one.
    late = set([i for i in toxic if not held(i)][1500:]) | {i for i in toxic if held(i) and i % 4 == 1}
    rows = []
    for i in sorted(place):
        words = rng.choices(vocab, k=8)
        if i % 2:
            words[rng.randrange(8)] = "grobby" if i in late else "snark"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in sorted(place)], "doc_id long, toxic int")
    for size in (T.CHUNK_ROWS * 2, 2000):
        monkeypatch.setattr(T, "CHUNK_ROWS", size)
        chunks = T.labelled(docs, labels)
        assert chunks.agg(F.sum("n"), F.sum("toxic")).head()[:] == (sum(not held(i) for i in place), sum(not held(i) for i in toxic))
        assert chunks.count() == (1 if size > 6000 else 3)
        got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
        assert np.mean([got[i].predicted for i in late if held(i)]) >= 0.95
        assert np.mean([got[i].predicted == i % 2 for i in got if held(i)]) >= 0.95
    again = {r.doc_id: r.score for r in T.toxicity(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in got)
