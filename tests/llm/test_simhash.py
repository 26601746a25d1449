import random
from collections import defaultdict

import xxhash

from tarnwell.llm.common import connected_components
from tarnwell.llm.simhash import SimHash, near_copy_search, near_duplicates


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, linked):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return {i: min(x for x in groups[find(i)]) for i in range(len(ids))}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "ß"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 40, 400]))) for _ in range(150)]
    for t in texts[:60]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append("\t" + " \n".join(w).upper())
    long = "long " * 60_000
    texts += ["", "", " \n", "same text here now"] + ["same text here now"] * 4 + [long, long + "end", None]
    return [(i * 3 + 7, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, node int")
    for chunk in (4096, 2):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs, chunk=chunk).collect()}
        prints = [brute_fingerprint(t) for _, t in rows]
        want = closure([i for i, _ in rows], lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
        assert got == {rows[k][0]: (f"{prints[k]:016x}", want[k]) for k in range(len(rows))}


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None), (2, ""), (None, "only here and there")], "doc_id long, text string")
    got = sorted(near_duplicates(docs).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(None, 4), (4, 4), (4, 4), (9, 2), (2, 2), (None, None)], key=lambda t: f"Row(doc_id={t[0]}, component_id={t[1]})")
    assert near_duplicates(docs.limit(0)).count() == 0


def test_trie_join_finds_every_near_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(12)})
    from tarnwell.llm.simhash import near_pairs

    nodes = spark.createDataFrame([(k, bytearray(x.to_bytes(8, "big"))) for k, x in enumerate(prints)], "node long, fp binary")
    want = closure(list(range(len(prints))), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    for chunk in (4096, 3):
        got = {k: k for k in range(len(prints))}
        got |= {r.node: r.root for r in connected_components(near_pairs(nodes, SimHash(), chunk)).collect()}
        assert got == want


def test_components_by_rounds_equal_one_task(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    df = spark.createDataFrame(edges + [(5, 5), (None, 3)], "a long, b long").repartition(7)
    one = sorted(map(tuple, connected_components(df).collect()))
    many = sorted(map(tuple, connected_components(df, finish_rows=0).collect()))
    assert one == many and len({n for n, _ in one}) == len(one)


def edited(rng, words, n, vocab):
    at = rng.randrange(len(words) - n)
    return words[:at] + rng.choices(vocab, k=n) + words[at + n :]


def test_candidates_at_the_threshold(spark):
    """Of pairs with a shingle-set similarity of 0.8 to 0.85 nearly all are candidates; unrelated ones never."""
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(4000)]
    rows, near = [], 0
    for g in range(300):
        words = rng.choices(vocab, k=rng.choice([14, 60, 300]))
        other = edited(rng, words, max(1, (len(words) - 4) // 9 - 4), vocab)
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            near += 1
            rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_copy_search(10_000)).collect()}
    assert near >= 100 and all(got[i] // 2 == i // 2 for i, _ in rows)
    assert sum(got[i] == i - 1 for i, _ in rows if i % 2) >= 0.98 * near


def test_candidates_count_a_repeated_shingle_once(spark):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(2000)]
    line = rng.choices(vocab, k=9)
    rows = []
    for g in range(10):
        one, other = rng.choices(vocab, k=150), rng.choices(vocab, k=150)
        rows += [(3 * g, " ".join(one + 40 * line)), (3 * g + 1, " ".join(other + 40 * line)), (3 * g + 2, " ".join(one + 2 * line))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_copy_search(10_000)).collect()}
    assert got == {i: i - 2 if i % 3 == 2 else i for i, _ in rows}


def test_settings_grow_with_the_documents():
    for n in (0, 10, 10_000, 10**6, 10**9):
        p = near_copy_search(n)
        assert p.rotations * p.lead_bits <= 64 and p.words >= p.checked
        apart = 0.151
        assert (1 - (1 - apart) ** p.lead_bits) ** (p.words * p.rotations) < 0.003
