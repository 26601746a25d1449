import random
from collections import Counter

import corpus_pipeline
from tarnwell.llm import bpe, mixing, secret_scan, toxicity


def write_tables(spark, folder):
    rng = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("lo", "mi", "ta", "ren", "su") for b in ("ka", "ve", "dor") for c in ("lin", "pu", "na", "")]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(vocab, k=rng.choice([15, 60, 150]))
        if i % 4 == 0:
            words.insert(3, rng.choice(["grobbly", "snarkful"]))
        if i % 9 == 1:
            words.insert(5, "password=Zk3vQ9xTb7LmW2pR8s")
        rows.append((i, " ".join(words), "en", f"s{i % 5 if i % 3 else 0}", None))
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(40):
        words = rows[6 * i + 1][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "s1", 5))
    rows += [(2000, None, "en", "s2", 0), (2001, "", None, None, 0), (30, rows[30][1], "en", "s0", None), (None, "only here", "en", "s3", 9), (None, "only here", "en", "s3", 9), (2002, "long " * 20_000, "en", "s4", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """(doc_id, text) of the document that stays of each near-copy group, by comparing all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_stages_against_plain(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    rows = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    words = toxicity.Words(model)
    bad = toxicity.scores(model, words, [r[1] for r in rows]) >= 0.5
    one = corpus_pipeline.drop_toxic(spark, docs, folder)
    clean = [r for r, b in zip(rows, bad) if not b]
    assert one.columns == columns and sorted(map(tuple, one.collect()), key=str) == sorted(clean, key=str)
    assert 40 <= sum(bad) <= 90

    two = corpus_pipeline.drop_near_duplicates(spark, one, folder)
    got = two.collect()
    assert two.columns == columns and Counter((r.doc_id, r.text) for r in got) == Counter(brute_kept([r[:2] for r in clean]))
    assert sum(r.doc_id is None for r in got) == 1

    three = corpus_pipeline.redact_secrets(spark, two, folder)
    texts = {r.doc_id: r.text for r in three.collect()}
    path = secret_scan.vocabulary_path()
    for r in got:
        if not secret_scan.scan_text(r.text, path)[1]:
            assert texts[r.doc_id] == r.text
        else:
            assert "Zk3vQ9xTb7LmW2pR8s" not in texts[r.doc_id] and "[assign]" in texts[r.doc_id]

    four = corpus_pipeline.mix_sources(spark, three, folder).collect()
    # Ids differ here but for the null one, so each document's own quota says how often it stays.
    keyed = three.selectExpr("struct(doc_id, xxhash64(doc_id, text, lang, source, n_chars) AS row_key) AS doc_id", "text", "source")
    times = {r.doc_id.doc_id: int(r.taken / r["size"] + 0.5) if r["size"] else 1 for r in mixing.mix(keyed).collect()}
    counts = Counter(r.doc_id for r in four)
    assert counts == {k: v for k, v in times.items() if v} and max(counts.values()) <= 3

    five = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert len(five) == len(four)
    for r in five:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, times int, row_key string, score double")


def test_stages_on_repeats_extra_columns_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark, folder)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(500)], k=n))
    one, other = text(40), text(40)
    big = 9007199254740993
    rows = [(7, one, "en", "s0", 1)] * 3 + [(7, other, "en", "s0", 1), (None, text(30), "de", None, 2), (None, text(30), "de", None, 2), (big, text(50), "en", "s1", 3), (big + 2, "", None, "s1", None), (big + 4, None, None, "s1", None)]
    docs = frame(spark, [(*r, 1, "x", 0.5) for r in rows])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(brute_kept([r[:2] for r in rows]))
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    got, sizes = Counter((r.doc_id, r.text) for r in mixed.collect()), Counter(r[:2] for r in rows)
    assert all(got[k] <= 3 * n for k, n in sizes.items()) and set(got) <= set(sizes)
    assert got[big + 2, ""] == got[big + 4, None] == 1
    # Equal rows are mixed one by one: three rows that are taken whole are three rows.
    same = frame(spark, [(5, one, "en", "s0", 1, 1, "x", 0.5)] * 3)
    assert corpus_pipeline.mix_sources(spark, same, folder).count() == 3
    redacted = corpus_pipeline.redact_secrets(spark, docs, folder)
    assert Counter((r.doc_id, r.text) for r in redacted.collect()) == sizes
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert set((r.doc_id, r.text) for r in clean.collect()) <= set(sizes)
    ids = corpus_pipeline.encode_bpe(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in ids) == Counter(r[0] for r in rows)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        assert name == "bpe" or out.columns == corpus_pipeline.COLUMNS, name
        assert step(spark, docs.limit(0), folder).count() == 0


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = corpus_pipeline.__file__.rsplit("/", 1)[0]
    for name in ("__spark_entry__.py",):
        shutil.copy(f"{root}/{name}", tmp_path)
    shutil.copytree(f"{root}/tarnwell", tmp_path / "tarnwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'A01_bm25' in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
