"""The classifier's numbers against plain loops, its gradients against differences."""

import random
import re

import numpy as np
import xxhash

from tarnwell.llm import toxicity as T


def plain_score(model, text):
    words = (text or "").split()
    rows = []
    for w in words:
        w = re.sub(r"^\W+|\W+$", "", w.lower())
        own = model.words[xxhash.xxh64_intdigest(w.encode()) % T.BUCKETS].astype(float)
        stem = sum((model.stems[xxhash.xxh64_intdigest(w[:k].encode(), 1) % T.BUCKETS].astype(float) for k in T.STEMS if k < len(w)), np.zeros(T.DIM))
        rows.append(np.concatenate([own, stem]))
    z = model.out_bias
    for k, (kernel, bias) in enumerate(zip(model.filters, model.biases)):
        for f in range(T.FILTERS):
            best = 0.0
            for at in range(len(rows)):
                value = float(bias[f])
                for w in range(len(kernel)):
                    if at + w < len(rows):
                        value += float(rows[at + w] @ kernel[w][:, f].astype(float))
                best = max(best, value)
            z += best * model.out[k * T.FILTERS + f]
    counts = [sum(re.sub(r"^\W+|\W+$", "", w.lower()) in text.split() for w in words) for text in T.FUNCTION_WORDS.values()]
    spoken = counts.index(max(counts)) if any(counts) else len(counts)
    return 1 / (1 + np.exp(-(z - model.shifts[spoken])))


def some_model(seed=3):
    rng = np.random.default_rng(seed)
    model = T.Model()
    model.words[:] = rng.normal(0, 0.5, model.words.shape)
    model.stems[:-1] = rng.normal(0, 0.3, (T.BUCKETS, T.DIM))
    model.filters = [rng.normal(0, 0.4, (w, 2 * T.DIM, T.FILTERS)).astype(np.float32) for w in T.WIDTHS]
    model.biases = [rng.normal(0, 0.2, T.FILTERS).astype(np.float32) for _ in T.WIDTHS]
    model.out = rng.normal(0, 0.3, T.FILTERS * len(T.WIDTHS))
    model.out_bias, model.shifts = 0.3, rng.normal(0, 1, len(T.LANGUAGES) + 1)
    return model


def test_scores_against_plain_loops(monkeypatch):
    rng = random.Random(2)
    vocab = ["the", "Der", "les", "que", "stone", "Steinwege,", "(cailloux)", "piedra!", "a", "--", "É", "of", "und"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(40)] + [None, "", " \n"]
    model = some_model()
    want = [plain_score(model, t) for t in texts]
    for piece in (T.PIECE, 8):
        monkeypatch.setattr(T, "PIECE", piece)
        assert np.allclose(T.scores(model, T.Words(model), texts), want, atol=1e-4)
    monkeypatch.setattr(T, "CACHE", 3)
    words = T.Words(model)
    assert np.allclose([T.scores(model, words, [t])[0] for t in texts], want, atol=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    model = some_model()
    model.filters = [f.astype(np.float64) for f in model.filters]
    model.biases = [b.astype(np.float64) for b in model.biases]
    reach, step = max(T.WIDTHS) - 1, 1e-5
    for n, label in ((12, 1.0), (5, 0.0), (1, 1.0)):
        x = np.concatenate([rng.normal(0, 0.5, (n, 2 * T.DIM)), np.zeros((reach, 2 * T.DIM))])
        _, found, grown = T.loss_gradients(model, x, label, 1.7)
        loss = lambda: T.loss_gradients(model, x, label, 1.7)[0]

        def slope(array, at):
            kept = array[at]
            array[at] = kept + step
            up = loss()
            array[at] = kept - step
            down = loss()
            array[at] = kept
            return (up - down) / (2 * step)

        for name, array in [("out", model.out), *((f"f{k}", f) for k, f in enumerate(model.filters)), *((f"b{k}", b) for k, b in enumerate(model.biases))]:
            for _ in range(6):
                at = tuple(int(rng.integers(0, d)) for d in array.shape)
                assert abs(slope(array, at) - found[name][at]) < 1e-4, (name, at)
        for _ in range(10):
            at = (int(rng.integers(0, n)), int(rng.integers(0, 2 * T.DIM)))
            assert abs(slope(x, at) - grown[at]) < 1e-4
        before = model.out_bias
        model.out_bias = before + step
        up = loss()
        model.out_bias = before - step
        down = loss()
        model.out_bias = before
        assert abs((up - down) / (2 * step) - found["bias"]) < 1e-4
