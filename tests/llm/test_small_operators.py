"""Per-text operators against plain versions, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnwell.llm import bpe, chat, quality, secret_scan, token_store, toxicity

EDGES = [(None, "null id"), (3, None), (4, ""), (5, "twice"), (5, "twice"), (6, "long " * 40_000), (-7, "x" * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, spans string, start int")


def plain_spans(text):
    text = text or ""
    found = []
    for kind, pattern, least, group in (
        (0, r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2),
        (1, r"AKIA[A-Z0-9]+", 18, 0),
        (2, r"[0-9a-f]+", 16, 0),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def test_secret_scan(spark):
    rng = random.Random(6)
    parts = ["password: ", "ToKeN='", "secret=", "api_key\"=", "APIKEY : ", "ſecret=abcdefghijklmnop", "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeef", " é\n", "🙂", "=", "a1b2c3", "hello world. ", "passwd", "abcdefghijklm"]
    rows = EDGES + [(100 + k, "".join(rng.choices(parts, k=rng.randrange(12)))) for k in range(400)]
    rows += [(9000, "key Zk3vQ9xTb7LmW2pR8sYc4Hd1 and 3f786850e387550fdaa6cd2a2ed5bd3a7c5e4c0b, 123e4567-e89b-12d3-a456-426614174000, keitlichenlichkeitbe 12345678901234567890123")]
    got = secret_scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    kinds = ("assign", "access", "hex")
    for r, (i, t) in zip(got, rows):
        want = plain_spans(t)
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex) == (i, *(sum(k == x for _, k, _ in want) for x in range(3)))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    secret = "Zk3vQ9xTb7LmW2pR8sYc"
    for before in ("production/database/master/", "connection_string=", "a_long_name_of_a_thing-"):
        text = f"see {before}{secret} there"
        s, e = text.index(secret), text.index(secret) + len(secret)
        assert any(a <= s and e <= b for a, b in secret_scan.random_runs(text, secret_scan.vocabulary_path())), before
    assert not secret_scan.random_runs("see production/database/master/configuration_of_the_thing there", secret_scan.vocabulary_path())
    u, h40, h64 = "3f2b8c1e-9d4a-4e7b-8a61-0c5d2f9b7e13", hashlib.sha1(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest()
    b64 = base64.b64encode(hashlib.sha256(b"x").digest()).decode()
    for known in (f"id={u}", f"user-{u}", f"/images/{u}/a", f"commit/{h40}", f"org/blob/{h40}/README", f"sha256={h64}", f"sha256-{b64}", f"SHA256={h64.upper()}", f"{u}_{u}"):
        assert not secret_scan.random_runs(f"see {known} there", secret_scan.vocabulary_path()), known
        for before in (known, known.replace(u, secret).replace(h40, secret).replace(h64, secret).replace(b64, secret)):
            text = f"see {before}/{secret} there"
            found = secret_scan.random_runs(text, secret_scan.vocabulary_path())
            assert any(a <= text.rindex(secret) and text.rindex(secret) + len(secret) <= b for a, b in found), text
    by_id = {r.doc_id: r for r in got}
    assert by_id[9000].n_random == 1 and "random:4:28" in by_id[9000].spans
    assert by_id[6].spans == by_id[-7].spans == ""
    clean = {r.doc_id: r.text for r in secret_scan.redact(frame(spark, rows)).collect()}
    assert clean[9000].startswith("key [random] and [hex], ") and clean[3] is None and clean[5] == "twice"
    assert secret_scan.scan(frame(spark, rows).limit(0)).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_quality(spark):
    rng = random.Random(9)
    rows = EDGES + [(100 + k, "".join(rng.choices(["a ", "b ", "c\n", "dd# ", "é\x0b", "\x1c", "| ", "\xa0", "x.\n", "\n"], k=rng.randrange(80)))) for k in range(300)]
    prose = "The quick brown fox jumps over the lazy dog near the old river bank today. " * 1
    rows += [(9000, prose + "\nAnother plain line stands here without any trouble at all.\n"), (9001, "Home | About | Contact | Login | Help\n" * 1 + "News | Sports | Weather | Maps | More\nA | B | C | D | E | F | G | H")]
    got = quality.judge(frame(spark, rows)).collect()
    for r, (i, t) in zip(got, rows):
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (i, *plain_quality(t)), (i, t)
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9000].kept and not by_id[9001].kept
    assert quality.clean_lines("Real text is here.\nAll rights reserved.\n")[0] == "Real text is here.\n"
    assert quality.judge(frame(spark, rows).limit(0)).count() == 0


FUZZ = ["aé", "foo,", "Bar.", "1234", "x'", "ǅ", "ʰ"] + list(" \n\t \r\x0b\x1c\x85\xa0 aAbZ'sS'T’09٣²ⅫéßİΣσςÅé漢🙂!?.,#|-_<>") + ["'re", "<|endoftext|>", "<|startoftext|>", "\n\n", "  ", "the ", "\x00"]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(FUZZ, k=rng.randrange(0, 40))) for _ in range(n)] + ["", " ", "\n", " a ", "a  b", "a \n b", "ab" * 2000 + " x"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.WordBpe(bpe.vocabulary_path())
    texts = fuzz(3000)
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == e.ids, text
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    word = bytes(random.Random(2).choices(range(97, 123), k=500))
    parts = [own.inner[b] for b in word[:-1]] + [own.last[word[-1]]]
    assert own._merge_short(list(parts)) == own._merge_long(list(parts))
    rows = EDGES + list(enumerate(texts[:200], 50))
    got = bpe.digests(frame(spark, rows)).collect()
    for r, (i, t) in zip(got, rows):
        e = library.encode(t or "", add_special_tokens=False)
        assert (r.doc_id, r.n_tokens) == (i, len(e.ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(frame(spark, rows).limit(0)).count() == 0


def test_token_store(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(token_store.vocabulary_path()), token_store.ByteEncoder(token_store.vocabulary_path())
    texts = fuzz(3000, 2)
    for text, e, blob in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode(texts)):
        assert np.frombuffer(blob, own.dtype).tolist() == e.ids, text
    rows = EDGES + [(k * 37 % 1009 + 50, t) for k, t in enumerate(texts[:600])]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for shard_bytes in (1 << 26, 300):
        manifest = token_store.write(frame(spark, rows).repartition(3), shard_bytes=shard_bytes)
        got = sorted(token_store.read(manifest).collect(), key=lambda r: r.start)
        at = 0
        for r, (i, t) in zip(got, order):
            ids = library.encode(t or "", add_special_tokens=False).ids + [2]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert len(got) == len(rows)
    first = manifest.orderBy("start").first()
    shard = token_store.Shard.open(first["path"])
    assert shard.null_ids and shard.document(0).tolist()[-1] == 2
    assert token_store.write_and_read(frame(spark, rows).limit(0)).count() == 0


def test_elias_fano():
    import io

    for top, n in ((0, 1), (5, 1), (10**9, 1000), (1000, 1000), (3, 700), (10**12, 257), (0, 0)):
        values = np.sort(np.random.default_rng(0).integers(0, top + 1, n))
        ef = token_store.EliasFano.read(io.BytesIO(token_store.EliasFano.of(values).to_bytes()))
        assert [int(v) for b in ef.blocks() for v in b] == values.tolist()
        assert [ef.select(k) for k in range(0, n, 97)] == values[::97].tolist()
        if n == 1000:
            assert len(ef.to_bytes()) * 8 < n * (2 + np.log2(max(2, top / n))) * 1.5 + 600
        with pytest.raises(IndexError):
            ef.select(n)


def plain_perspectives(rows):
    rows = [(c, t or 0, r or "unknown", x or "") for c, t, r, x in rows]
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r, x) for k, t, r, x in rows if k == c)
        for s in {r for _, r, _ in turns} - {"system"}:
            parts, mask, at = [], [], 0
            for _, r, x in turns:
                head = "<|" + ("assistant" if r == s else "system" if r == "system" else f"user:{r}") + "|>\n"
                parts += [head, x + "<|end|>\n"]
                at += len(head) + len(parts[-1])
                if r == s:
                    mask.append(f"{at - len(parts[-1])}:{at}")
            out[c, s] = (0, len(turns), len(mask), "".join(parts), ",".join(mask))
    return out


def test_chat(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "anna", "bob"]) if t else "system", rng.choice(["hi é🙂", "", None, "a\nb"])) for c in range(20) for t in range(rng.randrange(1, 150))]
    rows += [(None, 1, "user", "x"), (None, None, None, "y"), (77, 2, "user", "same"), (77, 2, "user", "same"), (78, 0, "system", "only"), (79, -70, "user", "neg")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, speaker string")
    rows.append((80, 1, "user", "long " * 40_000))
    df = df.union(spark.createDataFrame([(*rows[-1], "clash")], df.schema))
    for most in (1024, 7):
        got = chat.perspectives(df, most=most).collect()
        want = plain_perspectives(rows)
        assert {(r.conv_id, r.speaker): (r.part, r.n_turns, r.n_own, r.text, r.mask) for r in got} == want and len(got) == len(want)
    for r in got:
        spans = [tuple(map(int, s.split(":"))) for s in r.mask.split(",") if s]
        assert r.n_train == sum(e - s for s, e in spans) and all(r.text[s:e].endswith("<|end|>\n") for s, e in spans)
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_of_very_many_turns(spark):
    n = 100_000
    df = spark.range(n).selectExpr("1L AS conv_id", "IF(id % 9 = 0, NULL, id) AS turn", "IF(id % 3 = 0, 'anna', 'bob') AS role", "concat('turn ', id) AS text")
    got = {r.speaker: (r.part, r.n_turns, r.n_own, r.text, r.mask) for r in chat.perspectives(df).collect()}
    rows = [(1, None if k % 9 == 0 else k, "anna" if k % 3 == 0 else "bob", f"turn {k}") for k in range(n)]
    assert got == {s: row for (_, s), row in plain_perspectives(rows).items()}


def test_chat_goes_on_in_further_rows(spark):
    """Rows of a dialogue that is too long for one, put together again."""
    rows = [(1, t, ("anna", "bob")[t % 2], f"text {t} " * (t % 7)) for t in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat.perspectives(df, most_chars=4000).where("speaker = 'anna'").collect(), key=lambda r: r.part)
    _, n_turns, n_own, text, mask = plain_perspectives(rows)[1, "anna"]
    assert len(got) > 3 and "".join(r.text for r in got) == text
    assert (sum(r.n_turns for r in got), sum(r.n_own for r in got)) == (n_turns, n_own)
    moved, at = [], 0
    for r in got:
        moved += [f"{int(a) + at}:{int(b) + at}" for a, b in (s.split(":") for s in r.mask.split(",") if s)]
        at += len(r.text)
    assert ",".join(moved) == mask


def test_chat_sql(spark):
    import duckdb

    where = "/root/testdata/sf0.001"
    got = chat.perspectives(spark.read.parquet(f"{where}/conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{where}/conversations.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(chat.SQL).fetchall())


def test_toxicity(spark):
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("lo", "mi", "ta", "ren", "su") for b in ("ka", "ve", "dor", "lin", "pu")]
    rows, labels = list(EDGES), []
    for i in range(100, 500):
        words = rng.choices(vocab + ["the", "of", "and"], k=rng.choice([20, 60, 200]))
        bad = i % 3 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["Grobby!", "grobbling", "snark"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (9999, 0, 1), (5, 0, None)]
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: y for i, _, y in labels if i and i < 9000 and y is not None}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9
    again = toxicity.toxicity(docs.repartition(3), known).collect()
    assert {(r.doc_id, round(r.score, 4)) for r in out} == {(r.doc_id, round(r.score, 4)) for r in again}
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, known).collect()}
    assert kept == {r.doc_id for r in out if not r.predicted}
    assert toxicity.toxicity(docs.limit(0), known).count() == 0 and toxicity.toxicity(docs, known.limit(0)).count() == len(rows)
