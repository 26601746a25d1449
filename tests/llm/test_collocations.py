"""Collocations against counting every phrase, at any size of the dictionary, and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def plain(rows, least, most, absorbed, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= least}
    greatest = Counter()
    for (lang, p), f in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                greatest[lang, p[i : i + k]] = max(greatest[lang, p[i : i + k]], f)
    out = []
    for (lang, p), a in found.items():
        if 100 * greatest[lang, p] >= absorbed * a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    result = []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            result.append((r[0], ranks[r[0]], *r[1:]))
    return sorted(result)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "A", "ab", "é", "\x01x", "\x00", "a\x00b", "ß", "🙂", "the", "cat", "\xff", "zz"]
    ends = [" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "!?"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "und", "x\x01\x00y", ""])
        some = rng.choice([words, words[:4]])
        rows.append(("".join(rng.choice(some) + rng.choice(ends) for _ in range(rng.randrange(40))), lang))
    return rows + [(None, "en"), ("", None), ("the cat " * 3000, "en"), ("x" * 20_000, "en")]


@pytest.mark.parametrize(("least", "absorbed", "top", "codes"), [(5, 100, 2000, 1 << 18), (5, 80, 7, 4), (3, 100, 2000, 0)])
def test_equal_to_counting(spark, least, absorbed, top, codes):
    rows = texts(least + top, 400)
    docs = spark.createDataFrame([(None if k % 9 == 0 else k // 2, t, lang, "clash", 1) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    got = c.collocations(docs, least=least, absorbed=absorbed, top=top, codes=codes).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, 5, absorbed, top)
    assert all(type(x) is int for r in got for x in (r.rank, r.a, r.score))


def test_one_common_pair_over_many_tasks(spark):
    rows = [(f"new york {k} new york end{k % 3}", "en") for k in range(3000)]
    docs = spark.createDataFrame([(k, t, lang, "", 0) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = c.collocations(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == plain(rows, 100, 5, 100, 2000)


def test_stack_is_cut_anywhere():
    """Parts of the sorted suffixes, counted apart, add up to the whole."""
    rng = random.Random(3)
    codes = [c.code_of(0), c.code_of(300), c.code_of(1 << 17), c._in_full("l", b"q")]
    keys = Counter(b"".join(rng.choice(codes) for _ in range(rng.randrange(1, 6))) for _ in range(500))
    rows = sorted(keys.items(), reverse=True)
    whole = {p: n for p, _, n, _ in c.prefix_counts(iter(rows), 1)}
    for _ in range(50):
        at = sorted(rng.sample(range(len(rows) + 1), 3))
        total, closed = Counter(), set()
        for a, b in zip([0, *at], [*at, len(rows)]):
            for p, _, n, opened in c.prefix_counts(iter(rows[a:b]), 1):
                assert p not in closed and (opened or p not in total)
                total[p] += n
                if not opened:
                    closed.add(p)
        assert total == whole


def test_codes_are_read_back():
    codes = [c.code_of(i) for i in range(c.CODES)]
    assert len(set(codes)) == c.CODES and all(c._end(x, 0) == len(x) for x in codes)
    for lang, word in (("en", b"w"), ("", b"a\x00b"), ("x\x01\x00\x0b\x03y", "é\x01\x03".encode()), ("\x01\x03", b"\x01")):
        code = c._in_full(lang, word)
        assert c._from_full(code) == (lang, word) and c._end(code + b"\x05", 0) == len(code)


def test_large_numbers_are_exact(spark):
    assert spark.sql("SELECT (CAST(900000000000000 AS DECIMAL(18,0)) * CAST(1000 * 9000000000000000 AS DECIMAL(20,0))) div (CAST(900000000000001 AS DECIMAL(18,0)) * CAST(900000000000003 AS DECIMAL(18,0))) AS x").first().x == 1000 * 900000000000000 * 9000000000000000 // (900000000000001 * 900000000000003)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    got = c.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
    assert c.collocations(spark.createDataFrame([(1, None, None, "", 0), (2, "a, b.", "en", "", 0)], SCHEMA)).count() == 0


def test_stack_gets_what_is_frequent_only():
    """Sorted suffixes, shortened in blocks, give the same counts of two words and more; most rows don't reach the stack."""
    rng = random.Random(5)
    codes = [c.code_of(k) for k in (0, 1, 2, 127, 128, 300, 1 << 14, 1 << 17)] + [c._in_full("l", b"q"), c._in_full("l", b"qq" * 90), c._in_full("", b"a\x00")]
    for some, n_rows in ((codes, 4000), (codes[:2], 300), (codes, 1)):
        keys = Counter(b"".join(rng.choice(some) for _ in range(rng.randrange(2, 6))) for _ in range(n_rows))
        keys = sorted([*keys.items(), *list(keys.items())[::3]], reverse=True)
        for least in (1, 3, 12, 40):
            whole = [x for x in c.prefix_counts(iter(keys), least) if x[1] > 1]
            for block in (1, 7, 1000, 10_000):
                left = []
                for at in range(0, len(keys), block):
                    part = keys[at : at + block]
                    left += c.shortened(pa.array([b"!", *(k for k, _ in part)], pa.binary())[1:], np.array([n for _, n in part]), least, 5)
                assert sorted(x for x in c.prefix_counts(iter(left), least) if x[1] > 1) == sorted(whole)
                assert len(left) < len(keys) / 8 or block < 10_000 or least < 40 or len(keys) < 1000


def test_suffixes_end_before_rare_words(spark):
    """With more frequent words than codes, rare words still end a suffix."""
    rows = [(f"new york r{k} is big s{k}", lang) for lang in ("en", "und") for k in range(150)]
    docs = spark.createDataFrame([(k, t, lang, "", 0) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    for codes in (c.CODES, 3, 0):
        sent = spark.sparkContext.broadcast(c.Dictionary(c.word_counts(docs).where("n >= 100"), codes, c.MARKS))
        got = c.suffixes_of(docs, sent, 5, []).groupBy("key").agg(F.sum("n").alias("n")).collect()
        assert [r.n for r in got] == [150] * 4


@pytest.mark.parametrize(("codes", "marks"), [(1 << 18, 64), (6, 64), (6, 1 << 27), (0, 1 << 10)])
def test_marks_of_few_bits_change_nothing(spark, codes, marks):
    rows = texts(11, 400)
    docs = spark.createDataFrame([(k, t, lang, "", 0) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    assert sorted(map(tuple, c.collocations(docs, least=4, codes=codes, marks=marks).collect())) == plain(rows, 4, 5, 100, 2000)


def test_words_and_pieces():
    words, goes_on = c.words_of([b"\tThe  CAT.sat \xc3\xa9\x00\n\n", b"on", b" .", b"a\tb"])
    assert words.to_pylist() == [b"the", b"cat", b"sat", b"\xc3\xa9\x00", b"on", b"a", b"b"]
    assert goes_on.tolist() == [True, False, True, False, False, True, False]
    words, goes_on = c.words_of([b" .", b"\n"])
    assert len(words) == len(goes_on) == 0
