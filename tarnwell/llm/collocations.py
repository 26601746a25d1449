"""Phrase collocations by Suffix-sigma.

Every place of a text gives one suffix, cut to the longest phrase. The suffixes are
dealt out by language and first word and sorted in reverse lexicographic order; one
stack, which holds the prefixes of the last suffix, then counts all prefixes: what is
popped is complete. Counts of parts are joined to the phrases afterwards.

Distribution: suffixes are dealt out by ranges of themselves, which begin with
language and first word, so a very common first word, pair or phrase spreads over
several tasks. The ranges' bounds come from a sample and only balance the tasks. Only
the prefixes of a task's first and last suffix can go on in another task; these few are
marked and added up by phrase. Equal suffixes are counted together before they are
shuffled. Single words are counted first, as the dictionary needs that anyway.

Words are written as codes of one to three bytes, the most frequent ones in the
fewest (a dictionary of bounded size), and others in full. Suffixes end before words
that are too rare for a phrase: those without a code, or, where there are more frequent
words than codes, those that are not marked in a table of bounded size. Two words of one
mark only let a suffix go on that could have ended.

Texts are parsed, and words and suffixes counted, as whole columns of numpy and Arrow.
So are the sorted suffixes before they come to the stack: of each only the words stay
up to which its prefix is frequent, and what then is equal is added up. None of this
changes a result, only how much is shuffled and stacked.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import pieces, scope, small_batches, stage

LEAST = 100
MOST_WORDS = 5
ABSORBED = 100
TOP = 2000
NO_LANG = "und"
#: Words with a code of their own; so many are sent to all tasks (some tens of megabytes).
CODES = 1 << 18
#: Bits of a table of marks (16 MB); a power of two of at least 64.
MARKS = 1 << 27
#: Words, bytes of texts and suffixes that a task counts together before it hands them on.
HELD_WORDS, HELD_BYTES, HELD_SUFFIXES = 2 << 20, 32 << 20, 1 << 20

# A-Z lowered, the ends of pieces as line feeds, and tabs as spaces.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\v\f\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
#: First bytes of codes of two and three bytes and of a word in full; all others are codes of one byte.
_TWO, _THREE, _FULL = 0x80, 0xC0, 0xF0
#: Bytes of a code by its first byte; 0 of a word in full.
_LENGTHS = np.repeat(np.array([1, 2, 3, 0]), np.diff([0, _TWO, _THREE, _FULL, 256]))
#: Sorted suffixes that are looked at together before they come to the stack.
STACKED = 1 << 18
#: Sampled suffixes for each range.
_SAMPLED = 100


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in order, and whether another of the same piece comes after each."""
    plain = b"\n".join(texts).translate(_PLAIN)
    letters = np.frombuffer(plain, np.uint8)
    inside = np.zeros(len(letters) + 2, bool)
    inside[1:-1] = (letters != 32) & (letters != 10)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(edges[1::2] - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(plain.translate(None, b" \n"))])
    goes_on = np.ones(len(starts) + 1, bool)
    goes_on[np.searchsorted(starts, np.flatnonzero(letters == 10))] = False  # the first word of a piece
    goes_on[-1] = False
    return words, goes_on[1:]


def code_of(place: int) -> bytes:
    """The code of the word of this place by frequency. No code begins another."""
    if place < _TWO:
        return bytes([place])
    place -= _TWO
    if place < (_THREE - _TWO) << 8:
        return bytes([_TWO + (place >> 8), place & 255])
    place -= (_THREE - _TWO) << 8
    return bytes([_THREE + (place >> 16), place >> 8 & 255, place & 255])


_ESCAPED = {b"\1": b"\1", b"\2": b"\0", b"\3": b"\v"}


def _in_full(lang: str, word: bytes) -> bytes:
    """A word without a code: its language, a vertical tab, the word and a zero byte."""
    # Words hold no line feed, so that it can stand for a zero byte in them.
    lang = lang.encode().replace(b"\1", b"\1\1").replace(b"\0", b"\1\2").replace(b"\v", b"\1\3")
    return bytes([_FULL]) + lang + b"\v" + word.replace(b"\0", b"\n") + b"\0"


def _from_full(code: bytes) -> tuple[str, bytes]:
    lang, _, word = code[1:-1].partition(b"\v")
    lang = re.sub(rb"\x01(.)", lambda m: _ESCAPED[m.group(1)], lang)
    return lang.decode(), word.replace(b"\n", b"\0")


def _end(key: bytes, at: int) -> int:
    """Where the code that begins at ``at`` ends."""
    first = key[at]
    return at + 1 if first < _TWO else at + 2 if first < _THREE else at + 3 if first < _FULL else key.index(0, at) + 1


class Marks:
    """A set of numbers as bits of a table; it may seem to hold others of the same bit.

    Only the filled 64 bits of the table are sent, at most all of them.
    """

    def __init__(self, numbers: DataFrame, bits: int):
        slots = numbers.select((F.col("number") % bits).alias("slot")).select(F.expr("slot >> 6").alias("at"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
        filled = slots.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.bits, self.at, self.filled = bits, filled["at"].to_numpy(), filled["bits"].to_numpy().view(np.uint64)

    def test(self):
        """A function from an array of numbers to whether they are marked."""
        table = np.zeros(self.bits >> 6, np.uint64)
        table[self.at] = self.filled

        def among(numbers: np.ndarray) -> np.ndarray:
            slots = numbers.astype(np.uint64) & np.uint64(self.bits - 1)
            return (table[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)

        return among


def _held_words(batches) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """What ``words_of`` gives of many texts of a language together, HELD_WORDS at a time."""
    held: dict[str, list] = defaultdict(list)
    n = size = 0

    def joined(parts):
        words, goes_on = zip(*parts)
        return pa.concat_arrays(words), np.concatenate(goes_on)

    def hand_on():
        for lang in list(held):
            yield lang, *joined(held.pop(lang))
        pa.default_memory_pool().release_unused()

    for batch in batches:
        for piece in pieces(batch):
            texts: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist()):
                if text:
                    texts[lang].append(text)
            for lang, some in texts.items():
                words, goes_on = words_of(some)
                if len(words):
                    held[lang].append((words, goes_on))
                    n, size = n + len(words), size + sum(map(len, some))
            if n >= HELD_WORDS or size >= HELD_BYTES:
                yield from hand_on()
                n = size = 0
    yield from hand_on()


def _rows(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    rows = pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    for at in range(0, rows.num_rows, 10_000):
        yield rows.slice(at, 10_000)


def word_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every word: lang, word (binary), n."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        for lang, words, _ in _held_words(batches):
            counted = words.value_counts()
            yield from _rows(schema, [pa.repeat(lang, len(counted)), counted.field("values"), counted.field("counts")])

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Dictionary:
    """Coded words of each language, the most frequent ones, and marks of other frequent ones if there are more."""

    def __init__(self, frequent: DataFrame, codes: int, marks: int):
        # At most ``codes`` rows come to the driver: all that are frequent, or the most frequent.
        chosen = frequent.orderBy(F.desc("n"), "lang", "word").limit(codes).select("lang", "word").toArrow()
        langs = np.array(chosen["lang"].to_pylist(), object)
        words = chosen["word"].combine_chunks().cast(pa.binary())
        self.size = len(words)
        self.coded = {lang: (words.take(pa.array(at)), at) for lang in set(langs.tolist()) for at in [np.flatnonzero(langs == lang)]}
        others = frequent.select(F.crc32(F.concat(F.col("lang").cast("binary"), "word")).alias("number"))
        self.marks = Marks(others, marks) if frequent.count() > codes else None

    def spelled(self) -> dict[bytes, tuple[str, bytes]]:
        return {code_of(i): (lang, w) for lang, (words, at) in self.coded.items() for w, i in zip(words.to_pylist(), at.tolist())}

    def numbers(self):
        """A function from a language and its words to numbers of the words: places of codes, higher ones of other words, -1 of those that no phrase holds."""
        among = self.marks and self.marks.test()

        def of(lang: str, words: pa.Array) -> np.ndarray:
            numbers = np.full(len(words), -1, np.int64)
            if lang in self.coded:
                coded, at = self.coded[lang]
                found = pc.fill_null(pc.index_in(words, value_set=coded), -1).to_numpy(zero_copy_only=False)
                numbers[found >= 0] = at[found[found >= 0]]
            if among:
                rest, before = np.flatnonzero(numbers < 0), crc32(lang.encode())
                crcs = np.fromiter((crc32(w, before) for w in words.take(pa.array(rest)).to_pylist()), np.int64, len(rest))
                numbers[rest] = np.where(among(crcs), self.size + crcs, -1)
            return numbers

        return of


def suffixes_of(docs: DataFrame, sent, most: int, bounds: list[bytes]) -> DataFrame:
    """Different suffixes of two words and more that each task counts together: key (codes), range, n."""
    schema = pa.schema([("key", pa.binary()), ("range", pa.int32()), ("n", pa.int64())])

    def coded(lang, words, goes_on, of):
        """Codes (the first one empty), the place of each word's code in them, places where suffixes begin, and whether each word ends one."""
        known = words.dictionary_encode()
        distinct, index = of(lang, known.dictionary), known.indices.to_numpy()
        there = (distinct >= 0)[index]
        places = np.flatnonzero(there[:-1] & there[1:] & goes_on[:-1])
        ends = np.ones(len(index), bool)
        ends[places] = False
        used = np.flatnonzero(distinct >= 0)
        spelled = zip(distinct[used].tolist(), known.dictionary.take(pa.array(used)).to_pylist())
        codes = pa.array([b"", *(code_of(i) if i < sent.value.size else _in_full(lang, w) for i, w in spelled)], pa.binary())
        code = np.zeros(len(distinct), np.int32)
        code[used] = np.arange(1, len(used) + 1)
        return codes, code[index], places, ends

    def counted(codes, code, at, ends):
        parts, here = [codes.take(pa.array(code[at]))], np.ones(len(at), bool)
        for _ in range(1, most):
            here = here & ~ends[at]
            at = np.where(here, at + 1, at)
            parts.append(codes.take(pa.array(np.where(here, code[at], 0))))
        found = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary())).value_counts()
        order = pc.sort_indices(found.field("values"))
        keys = found.field("values").take(order)
        cuts = [bisect_left(range(len(keys)), b, key=lambda i: keys[i].as_py()) for b in bounds]
        return [keys, np.repeat(np.arange(len(bounds) + 1), np.diff([0, *cuts, len(keys)])), found.field("counts").take(order)]

    def run(batches):
        of = sent.value.numbers()
        for lang, words, goes_on in _held_words(batches):
            codes, code, places, ends = coded(lang, words, goes_on, of)
            del words, goes_on
            for first in range(0, len(places), HELD_SUFFIXES):
                yield from _rows(schema, counted(codes, code, places[first : first + HELD_SUFFIXES], ends))

    return docs.mapInArrow(run, "key binary, range int, n long")


def shortened(keys: pa.Array, n: np.ndarray, least: int, most: int) -> Iterator[tuple[bytes, int]]:
    """Sorted suffixes, each up to the words of its longest prefix of ``least`` occurrences, equal neighbours added up.

    Those without such a prefix of two words are left out. Prefixes of the first and of the
    last suffix may occur before or after, so suffixes that share one keep it.
    """
    rows, offsets = len(keys), np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    data = keys.buffers()[2].to_pybytes()
    letters = np.frombuffer(data + b"\0", np.uint8)
    starts, lengths = offsets[:-1], np.diff(offsets)
    # Bytes in common with the suffix before.
    common = np.zeros(rows, np.int64)
    same, shorter = np.arange(1, rows), np.minimum(lengths[1:], lengths[:-1])
    for at in range(int(shorter.max(initial=0))):
        same = same[shorter[same - 1] > at]
        same = same[letters[starts[same] + at] == letters[starts[same - 1] + at]]
        if not len(same):
            break
        common[same] = at + 1
    zeros = np.flatnonzero(letters == 0)
    kept, upto, end = np.zeros(rows, bool), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for k in range(1, most + 1):
        there = end < lengths
        step = _LENGTHS[letters[starts + np.where(there, end, 0)]]
        if len(full := np.flatnonzero(there & (step == 0))):
            at = starts[full] + end[full]
            step[full] = zeros[np.searchsorted(zeros, at)] + 1 - at
        end = np.where(there, end + step, end)
        if k > 1:
            begins = ~there | (common < end)
            begins[0] = True
            run, total = np.cumsum(begins) - 1, np.add.reduceat(n, np.flatnonzero(begins))
            total[[0, -1]] = least
            now = there & (total >= least)[run]
            kept |= now
            upto[now] = end[now]
    at = np.flatnonzero(kept)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (upto[at[1:]] != upto[at[:-1]]) | (common[at[1:]] < upto[at[1:]])
    first = np.flatnonzero(new)
    at, n = at[first], np.add.reduceat(n[at], first)
    yield from zip([data[a:b] for a, b in zip(starts[at].tolist(), (starts[at] + upto[at]).tolist())], n.tolist())


def prefix_counts(rows, least: int) -> Iterator[tuple[bytes, int, int, bool]]:
    """(prefix, words, count, open) of sorted (suffix, count): complete ones of ``least`` and more, and all open ones.

    Open are the prefixes of the first and of the last suffix, which may go on before or after.
    """
    prefixes: list[bytes] = []  # of the last suffix, one word more each
    counts: list[int] = []
    first = 0  # so many of them have been there since the first suffix

    def pop():
        nonlocal first
        prefix, n = prefixes.pop(), counts.pop()
        if counts:
            counts[-1] += n
        opened = len(prefixes) < first
        first = min(first, len(prefixes))
        return (prefix, len(prefixes) + 1, n, opened) if opened or n >= least else None

    begun = False
    for key, n in rows:
        while prefixes and not key.startswith(prefixes[-1]):
            if (found := pop()) is not None:
                yield found
        at = len(prefixes[-1]) if prefixes else 0
        while at < len(key):
            at = _end(key, at)
            prefixes.append(key[:at])
            counts.append(0)
        counts[-1] += n
        if not begun:
            begun, first = True, len(prefixes)
    first = len(prefixes)
    while prefixes:
        yield pop()


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, codes: int = CODES, marks: int = MARKS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of up to ``most`` words and ``least`` occurrences, and (lang, n)."""
    spark = docs.sparkSession
    words = stage(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    sent = spark.sparkContext.broadcast(Dictionary(frequent, codes, marks))
    # Bounds of the ranges by a sample of texts; they change how even the tasks are and nothing else.
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    wanted = _SAMPLED * n_ranges
    some = suffixes_of(docs.sample(min(1.0, 50 * wanted / max(n_words, 1)), seed=1), sent, most, []).select("key")
    keys = sorted(bytes(r["key"]) for r in some.orderBy(F.xxhash64("key")).limit(wanted).collect())
    bounds = sorted({keys[k * len(keys) // n_ranges] for k in range(1, n_ranges)}) if keys else []
    suffixes = suffixes_of(docs, sent, most, bounds).repartitionById(len(bounds) + 1, F.col("range")).drop("range").sortWithinPartitions(F.desc("key"))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64()), ("open", pa.bool_())])

    def together(held):
        keys = pa.concat_arrays([b.column("key").cast(pa.binary()) for b in held])
        return shortened(keys, np.concatenate([b.column("n").to_numpy() for b in held]), least, most)

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= STACKED:
                yield from together(held)
                held, size = [], 0
        if size:
            yield from together(held)

    def run(batches):
        spelled = sent.value.spelled()
        found = []

        def spell(key: bytes) -> tuple[str, str]:
            at, parts = 0, []
            while at < len(key):
                end = _end(key, at)
                code = key[at:end]
                parts.append(spelled[code] if code in spelled else _from_full(code))
                at = end
            return parts[0][0], b" ".join(w for _, w in parts).decode()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            found.clear()
            return out

        for key, k, f, opened in prefix_counts(rows(batches), least):
            if k > 1:
                found.append((*spell(key), k, f, opened))
                if len(found) == 10_000:
                    yield batch()
        if found:
            yield batch()

    counted = stage(suffixes.mapInArrow(run, "lang string, phrase string, words int, f long, open boolean"), "prefixes")
    parts = counted.where("open").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    single = frequent.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    return stage(counted.where("NOT open").drop("open").unionByName(parts).unionByName(single), "phrases", keep=True), totals


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, absorbed: int = ABSORBED, top: int = TOP, codes: int = CODES, marks: int = MARKS) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``most`` words with ``least`` occurrences (a) is a candidate. Cut in
    two parts with l and r occurrences it scores floor(1000 a n / (l r)) where n is the
    number of the language's words; its lowest cut counts, of equal ones the first. One
    that lies in a longer candidate of ``absorbed`` percent of its occurrences or more is
    dropped. A language's ``top`` phrases stay, by score, then a, both descending, then
    the phrase by its bytes. All numbers are exact longs.

    A null lang is "und". Null and empty texts have no words; repeated rows count each
    time; an empty table gives no rows. Only text and lang are read, so other columns
    don't clash. A very long text is one row and gives its suffixes as any other.
    """
    with scope(docs.sparkSession):
        slim = small_batches(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")))
        counts, totals = phrase_counts(slim, least, most, codes, marks)
        totals = stage(totals, "totals", keep=True)
    candidates = counts.where("words > 1")
    parted = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", "words", "f", parted.alias("of"))
    inside = longer.select("lang", "f", "of", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    inside = inside.select("lang", "f", "of", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("start"))
    inside = inside.select("lang", F.array_join(F.slice("of", F.col("start"), F.col("k")), " ").alias("phrase"), "f")
    greatest = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(greatest, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * absorbed)).drop("most")

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), parted.alias("of"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    size = F.size("of")
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("of", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("of", F.col("k") + 1, size - F.col("k")), " ").alias("rest"),
    )
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    exact = F.expr("(CAST(a AS DECIMAL(18, 0)) * CAST(1000 * n AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    best = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same in DuckDB SQL: every phrase of every length is written out and counted.
SQL = f"""
WITH split AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
  SELECT lang, w[i] AS phrase, 1 AS words FROM placed
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM placed WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM placed WHERE i + 2 <= len(w)
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3], 4 FROM placed WHERE i + 3 <= len(w)
  UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4], 5 FROM placed WHERE i + 4 <= len(w)
), counts AS (SELECT lang, phrase, words, count(*) AS f FROM grams GROUP BY lang, phrase, words HAVING count(*) >= {LEAST}),
candidates AS (SELECT *, string_split(phrase, ' ') AS of FROM counts WHERE words > 1),
inside AS (
  SELECT c.lang, array_to_string(c.of[s:s + k - 1], ' ') AS phrase, c.f
  FROM candidates c, (SELECT unnest([2, 3, 4]) AS k) lengths, (SELECT unnest([1, 2, 3, 4]) AS s) starts
  WHERE k < c.words AND s + k - 1 <= c.words
), greatest_of AS (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY lang, phrase),
kept AS (SELECT c.* FROM candidates c LEFT JOIN greatest_of g ON g.lang = c.lang AND g.phrase = c.phrase WHERE g.most IS NULL OR 100 * g.most < {ABSORBED} * c.f),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, t.n,
    CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM kept c JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < c.words
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.of[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.of[k + 1:c.words], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
