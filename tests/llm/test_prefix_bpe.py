"""Prefix tables against the library's encoding: texts, appends, edits, edge cases."""

import base64
import hashlib
import random

import pytest

from tarnwell.llm import prefix_bpe as x

LETTERS = [*"abcdeé ñthing''s 're \n\t  12٣½ 🙂日本語　\x1c\x85...ing tion", "  ", "\n\n", "'ll", "'r", "x" * 30, "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(x.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return x.Encoder(x.vocabulary_path())


def test_texts(encoder, library):
    rng = random.Random(12)
    for _ in range(1500):
        text = "".join(rng.choices(LETTERS, k=rng.randrange(50)))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert encoder.decode(ids) == encoder.decode_names(encoder.names(text)) == text.encode()


def test_long_words(encoder, library):
    rng = random.Random(1)
    for text in ("x" * 20_000, "".join(rng.choices("abcdefghij", k=20_000)), " " * 5_000 + "a", "日本" * 3_000):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_table_has_one_token_for_every_prefix(encoder):
    word = " antidisestablishmentarianismus".encode()
    table, v = x.PrefixTable(encoder.vocabulary, word), encoder.vocabulary
    for i in range(1, len(word) + 1):
        ends = [t for t in range(v.size) if v.tokens[t] and word[:i].endswith(v.tokens[t]) and v.pair(table.last[i - len(v.tokens[t])], t)]
        assert ends == [table.last[i]]


def test_append_and_replace_bytes(encoder):
    rng = random.Random(2)
    word = "".join(rng.choices("abcdefghij", k=3000)).encode()
    table = x.PrefixTable(encoder.vocabulary, word[:1000])
    table.append(word[1000:])
    assert table.last == x.PrefixTable(encoder.vocabulary, word).last
    for _ in range(100):
        a = rng.randrange(len(table.data))
        b = min(len(table.data), a + rng.randrange(4))
        new = "".join(rng.choices("abcxyz", k=rng.randrange(4))).encode()
        filled = table.replace(a, b, new)
        assert table.last == x.PrefixTable(encoder.vocabulary, bytes(table.data)).last
        assert filled <= 300  # what is far from the edit is not filled again


def test_edited_texts(encoder, library):
    rng = random.Random(3)
    for _ in range(600):
        table = x.TextTable(encoder, "".join(rng.choices(LETTERS, k=rng.randrange(60))))
        for _ in range(3):
            a = rng.randrange(len(table.text) + 1)
            b = rng.randrange(a, min(len(table.text), a + 5) + 1)
            new = "".join(rng.choices(LETTERS, k=rng.randrange(4)))
            before = table.text
            edited = table.append(new) if rng.random() < 0.3 else table.edited(a, b, new)
            assert edited.ids() == library.encode_ordinary(edited.text), (before, a, b, new)
            assert table.text == before
            table = edited


ROWS = [(None, "null id"), (3, None), (4, ""), (5, "twice"), (5, "twice"), (6, "long " * 40_000), (-7, "x" * 30_000), (2**60 + 1, "a<|endoftext|>b")]


def test_query_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = x.digests(docs).collect()
    assert [r.doc_id for r in got] == [i for i, _ in ROWS]
    for r, (_, t) in zip(got, ROWS):
        ids = library.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.lossless
    assert [list(r.ids) for r in x.encode(docs).collect()] == [library.encode_ordinary(t or "") for _, t in ROWS]
    assert x.digests(docs.limit(0)).count() == x.encode(docs.limit(0)).count() == 0


def test_edits_as_a_table(spark, library):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, None), (None, "no id"), (3, "é🙂 end")], "doc_id long, text string")
    edits = [(1, 1, 4, 7, "dog"), (1, 2, 11, 11, " on it"), (1, 3, None, None, "!"), (1, 4, 9, 2, "zz"), (2, 5, 0, 3, "new"), (3, 6, 1, 2, None), (9, 7, 0, 0, "x"), (None, 8, 0, 0, "x"), (1, 2, 11, 11, " on it")]
    got = x.encode_edits(docs, spark.createDataFrame(edits, "doc_id long, edit_id long, start long, stop long, new string")).collect()
    want = {1: "the dog sat", 2: "the cat sat on it", 3: "the cat sat!", 4: "the cat szzat", 5: "new", 6: "é end"}
    assert sorted((r.edit_id, list(r.ids), r.n_tokens) for r in got) == sorted((k, library.encode_ordinary(t), len(library.encode_ordinary(t))) for k, t in [*want.items(), (2, want[2])])
