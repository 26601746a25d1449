import random
from collections import defaultdict

import corpus_pipeline
from tarnwell.llm.near_copies import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Least doc_id of each row's group, by exact Jaccard of all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)] += [d] if d is not None else []
    return [(d, min(ids[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def replaced(rng, words, n, vocab):
    at = rng.randrange(len(words) - n)
    return words[:at] + rng.choices(vocab, k=n) + words[at + n :]


def corpus():
    """Originals with copies around the threshold, one template's variants, and edge cases."""
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        words = rng.choices(vocab, k=rng.choice([12, 60, 300]))
        n = (len(words) - 4) // 9 - 4  # a run of n words is about at the threshold
        texts += [words] + [replaced(rng, words, max(1, n + k), vocab) for k in (-6, -3, -1, 0, 1, 3)]
    base = rng.choices(vocab, k=200)
    texts += [replaced(rng, base, n, vocab) for n in (1, 2, 8, 12, 16, 20) * 6]
    line = rng.choices(vocab, k=9)
    one, other = rng.choices(vocab, k=150), rng.choices(vocab, k=150)
    texts += [one + 40 * line, other + 40 * line, one + 2 * line]
    rows = [(3 * i + 1, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(5000, None), (5001, ""), (None, "only here and there"), (5002, "a b"), (5003, "A \n b"), (None, "a b"), (5002, "a b")]


def test_against_brute_force_jaccard(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows), key=str)
    assert 40 < len({c for _, c in want}) < 0.7 * len(rows)
    for chunk in (512, 4):
        assert sorted(map(tuple, near_copies(docs, chunk).select("doc_id", "component_id").collect()), key=str) == want
    assert near_copies(docs.limit(0)).count() == 0


def test_stage_keeps_what_is_below_the_threshold(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 5000]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in brute(rows) if i == c)
