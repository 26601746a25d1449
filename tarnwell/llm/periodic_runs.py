"""Periodic runs of words, found by a suffix automaton.

Each state of the automaton of a text stands for factors that end at the same
places. The places of a state are those of the states below it in the tree of
suffix links, merged the smaller set into the larger. Where a merge makes two places
neighbours whose distance is no more than the state's length, the factor of that
length ends at both: a square, whose period is the distance. Such a period is the
smallest, since a smaller one would have put a place in between. From the square the
run is extended while words a period apart are equal.

In a run every word after the first period was seen at most a period ago. Stretches
of a text in which no run can lie by this are left out before the automaton is
built, so that plain prose costs one sort of its words.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import pieces, small_batches

#: A run has so many words, and so many times its period, at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Places that one bucket of an ordered set holds before it is cut in two.
BUCKET = 1024


class Places:
    """An ordered set of integers in buckets, so that an insertion moves a bounded number of them."""

    __slots__ = ("buckets", "greatest", "size")

    def __init__(self, place: int | None = None):
        self.buckets: list[list[int]] = [] if place is None else [[place]]
        self.greatest: list[int] = [] if place is None else [place]
        self.size = 0 if place is None else 1

    def __iter__(self) -> Iterator[int]:
        for bucket in self.buckets:
            yield from bucket

    def add(self, place: int) -> None:
        self.size += 1
        if not self.buckets:
            self.buckets, self.greatest = [[place]], [place]
            return
        k = min(bisect_left(self.greatest, place), len(self.buckets) - 1)
        bucket = self.buckets[k]
        insort(bucket, place)
        self.greatest[k] = bucket[-1]
        if len(bucket) > BUCKET:
            half = len(bucket) // 2
            self.buckets[k : k + 1] = [bucket[:half], bucket[half:]]
            self.greatest[k : k + 1] = [bucket[half - 1], bucket[-1]]

    def around(self, place: int) -> tuple[int | None, int | None]:
        """The neighbours of a place of the set."""
        k = bisect_left(self.greatest, place)
        bucket = self.buckets[k]
        i = bisect_left(bucket, place)
        before = bucket[i - 1] if i else self.buckets[k - 1][-1] if k else None
        after = bucket[i + 1] if i + 1 < len(bucket) else self.buckets[k + 1][0] if k + 1 < len(self.buckets) else None
        return before, after


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, place) of every state; a place of -1 is a copy's."""
    step: list[dict[int, int]] = [{}]
    length, link, place = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(word):
        state = len(length)
        step.append({})
        length.append(i + 1)
        link.append(0)
        place.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(length)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                place.append(-1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return length, link, place


def squares(word: list[int]) -> Iterator[tuple[int, int]]:
    """(period, place of the last word) of a square in every run of two periods or more."""
    length, link, place = automaton(word)
    sets: list[Places | None] = [Places(p if p >= 0 else None) for p in place]
    for v in np.argsort(-np.asarray(length), kind="stable").tolist():
        up = link[v]
        if up <= 0:  # factors of no words are no squares
            sets[v] = None
            continue
        small, large, sets[v] = sets[v], sets[up], None
        if small.size > large.size:
            small, large = large, small
        sets[up] = large
        new = list(small)
        for x in new:
            large.add(x)
        most = length[up]
        for x in new:
            before, after = large.around(x)
            if before is not None and x - before <= most:
                yield x - before, x
            if after is not None and after - x <= most:
                yield after - x, after


def candidates(word: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, end) that hold every run of LEAST_TIMES periods and LEAST_WORDS words.

    A word of a run after the first period is at most a period from its last occurrence,
    and there are LEAST_TIMES - 1 periods of such words side by side. So a word goes whose
    distance, that many times, is over the length of its stretch, which may cut that
    stretch, until nothing changes.
    """
    n, times = len(word), LEAST_TIMES - 1
    if n < LEAST_WORDS:
        return []
    order = np.argsort(word, kind="stable")
    gap = np.full(n, n + 1, np.int64)
    same = word[order[1:]] == word[order[:-1]]
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    alive = gap * times <= n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sizes = ends - starts
        if not len(sizes):
            return []
        stretch = np.repeat(sizes, sizes)
        inside = np.flatnonzero(alive)
        # A period of 1 has the fewest words after its first period.
        gone = inside[(gap[inside] * times > stretch) | (stretch < LEAST_WORDS - 1)]
        if not len(gone):
            break
        alive[gone] = False
    found: list[tuple[int, int]] = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        s = max(0, s - (e - s) // times)
        if found and s <= found[-1][1]:
            found[-1] = (found[-1][0], e)
        else:
            found.append((s, e))
    return found


def runs(word: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for begin, end in candidates(word):
        for period, last in squares(word[begin:end].tolist()):
            last += begin
            known = found[period]
            k = bisect_left(known, (last + 1,))
            # Runs of one period overlap in less than it, so a square lies in one of them only.
            if any(s <= last - 2 * period + 1 and last < e for s, e in known[max(k - 2, 0) : k]):
                continue
            stop = last + 1 + _equal(word, last + 1, period, 1)
            start = last - period + 1 - _equal(word, last, period, -1)
            insort(known, (start, stop))
    least = lambda q: max(LEAST_WORDS, LEAST_TIMES * q)
    return sorted((s, e - s, q) for q, all_of in found.items() for s, e in all_of if e - s >= least(q))


def _equal(word: np.ndarray, at: int, period: int, way: int) -> int:
    """How many words from ``at`` on, in one direction, equal those a period before them."""
    n, most = 0, 64
    while True:
        if way > 0:
            a, b = word[at + n : at + n + most], word[at + n - period : at + n - period + most]
            b = b[: len(a)]
        else:
            low = max(at - n - most + 1, period)
            a, b = word[low : max(at - n + 1, low)][::-1], word[low - period : max(at - n + 1, low) - period][::-1]
        if not len(a):
            return n
        differs = np.flatnonzero(a != b)
        if len(differs):
            return n + int(differs[0])
        n += len(a)
        most = min(most * 4, 1 << 16)


def planted(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(first word, period) of the words that repeat in this document by its id's checksum, if any do."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _row(text: bytes | None, plant, doc_id: int | None) -> tuple:
    words = (text or b"").split()  # bytes split at U+0020 and U+0009 to U+000D only
    if plant is not None and (found := plant(len(words), doc_id)):
        a, p = found
        period = words[a : a + p]
        words[a:] = (period * ((len(words) - a) // len(period) + 1))[: len(words) - a]
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    all_runs = runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    if all_runs:
        kept = np.ones(len(words), bool)
        for start, length, period in all_runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    best = None
    for run in all_runs:  # the first of equal ones stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = b"".join(b"%d,%d,%d\n" % run for run in all_runs)
    of_best = (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return len(all_runs), *of_best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), all_runs, b" ".join(words)


#: Columns of the digest, in the order of ``_row``.
_DIGEST = {
    "n_runs": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "period": pa.int64(),
    "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(),
    "collapsed_sha256": pa.string(),
}


def _per_document(docs: DataFrame, plant, schema: pa.Schema, names: str, pick) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                ids = piece.column("doc_id")
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                columns = pick([_row(t, plant, i) for t, i in zip(texts, ids.to_pylist())])
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([ids, *arrays], schema=schema)

    slim = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return slim.mapInArrow(run, names)


def digests(docs: DataFrame, plant=planted) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of the greatest exponent, and digests.

    ``plant`` tells from the number of words and the doc_id which of them repeat first
    (none if it is None). Of equal exponents the run of the least start, then period,
    counts; without a run its four columns are null. runs_sha256 is of every run's
    ``start,length,period`` line, collapsed_sha256 of the words without those that
    repeat a run's first period. Null and empty texts have no words and no run; a null
    doc_id stays null and nothing is planted for it. Repeated rows come back repeated,
    an empty table gives no rows. Only doc_id and text are read, so other columns don't
    clash. A text of any length is one row; its automaton is as long as the stretches
    of it that may repeat.
    """
    schema = pa.schema([("doc_id", pa.int64()), *_DIGEST.items()])
    names = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _per_document(docs, plant, schema, names, lambda rows: list(zip(*(r[:7] for r in rows))) or [[]] * 7)


def find(docs: DataFrame) -> DataFrame:
    """The runs themselves and the text without the repeats: doc_id, runs (start, length, period), collapsed.

    Rows and cases as in ``digests``; nothing is planted.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

    def pick(rows):
        named = [[dict(zip(("start", "length", "period"), run)) for run in r[7]] for r in rows]
        return [named, pc.cast(pa.array([r[8] for r in rows], pa.binary()), pa.string()).to_pylist()]

    return _per_document(docs, None, schema, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string", pick)
