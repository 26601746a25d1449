"""Toxicity: a small convolutional text classifier, trained in numpy.

Every word has a hashed vector of its own and the sum of the hashed vectors of its
beginnings (so that inflected and compound forms of a stem share one). Filters of
several widths run over the word vectors, each filter keeps its greatest value over the whole text
(max pooling), and a logistic layer gives a raw score. Cut-offs are calibrated for
each language, which is guessed from the text's own function words, and the score
is shifted so that 0.5 is that language's cut-off.

The model is fitted on all labelled rows that are not held out: two thirds of them give
the weights, the third that these didn't see gives the cut-offs. The texts are packed
once, as numbers, into chunks of some thousand. In a round each chunk is a piece of work
that starts from the shared weights and trains on its own texts; what the chunks changed
is averaged by their numbers of texts. A round's result is as large as the model,
whatever the input. Sums are of integers, so that their order doesn't matter. Cut-offs
come from counts of logits in steps of 1/1024. All rows are scored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import forget, held, per_text, pieces, scope, small_batches, stage, write
from tarnwell.llm.near_copies import parted_by

#: Labelled texts of a chunk, about, and bytes of its texts at most; a longer text is a chunk of its own.
CHUNK_ROWS, CHUNK_BYTES = 4096, 16 << 20
#: Texts that the fit goes through at least, if need be again and again, and bounds on how often it does.
LEAST_STEPS, FEWEST, MOST = 9000, 3, 40
BUCKETS = 1 << 16
#: Lengths of the beginnings of a word that are hashed; only those shorter than the word.
STEMS = range(2, 10)
#: Dimensions of the word's and of the beginnings' vector.
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Words of a text that are convolved at a time; pooling goes on over the pieces.
PIECE = 1 << 15
CACHE = 250_000
#: Texts a step of the fit, and its rate.
BATCH, RATE = 16, 0.1
_EDGE = re.compile(r"^\W+|\W+$")

# Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with as are on be at by this from or an not have",
    "de": "der die das und ist nicht den von mit ein eine dem sich auf für im als auch es zu wird sind",
    "fr": "le la les des et est une du dans que qui pour pas sur au plus par avec un ce son ne",
    "es": "el los las del y que en es por con para una se al lo como más su no un",
}
LANGUAGES = tuple(FUNCTION_WORDS)


@dataclass
class Model:
    """Weights, and cut-offs as shifts of the logit by language; the last is for texts of no known one."""

    words: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    #: The last row, of no beginning, stays zero.
    stems: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS)))
    out_bias: float = 0.0
    shifts: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    #: Names the model in a worker that keeps its words.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[buckets[:, 0]], self.stems[buckets[:, 1:]].sum(axis=1)], axis=1)


def _plain(word: str) -> str:
    """A word in lower case, without what isn't part of a word at its ends."""
    word = word.lower()
    return word if word[0].isalnum() and word[-1].isalnum() else _EDGE.sub("", word)


def _hashes(data: np.ndarray) -> np.ndarray:
    """XXH64 of seed 1 of rows of under 32 bytes, as xxhash gives it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda h, k: (h << np.uint64(k)) | (h >> np.uint64(64 - k))
    lane = lambda at, size: np.ascontiguousarray(data[:, at : at + size]).view(f"<u{size}")[:, 0].astype(np.uint64)
    n, at = data.shape[1], 0
    h = np.full(len(data), p5 + np.uint64(1 + n), np.uint64)
    while n - at >= 8:
        h = turn(h ^ (turn(lane(at, 8) * p2, 31) * p1), 27) * p1 + p4
        at += 8
    if n - at >= 4:
        h = turn(h ^ (lane(at, 4) * p1), 23) * p2 + p3
        at += 4
    for k in range(at, n):
        h = turn(h ^ (data[:, k].astype(np.uint64) * p5), 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def word_buckets(plain: list[str]) -> np.ndarray:
    """Buckets of words and of their beginnings, BUCKETS where there is none; beginnings of a length in bytes are hashed together."""
    codes = [w.encode("utf-8", "surrogatepass") for w in plain]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    out = np.full((len(plain), 1 + len(STEMS)), BUCKETS, np.int32)
    out[:, 0] = np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes)) % np.uint64(BUCKETS)
    simple = np.fromiter(map(len, codes), np.int64, len(codes)) == sizes
    for rows, width in ((np.flatnonzero(simple), STEMS.stop - 1), (np.flatnonzero(~simple), 32)):
        heads = np.array([codes[i] for i in rows], f"S{width}").view(np.uint8).reshape(len(rows), width)
        # Characters begun up to each byte.
        begun = None if width < 32 else np.cumsum((heads & 0xC0) != 0x80, axis=1, dtype=np.int8)
        for j, k in enumerate(STEMS, 1):
            own = np.flatnonzero(sizes[rows] > k)
            ends = np.full(len(own), k) if begun is None else (begun[own] <= k).sum(axis=1)
            for n in np.unique(ends):
                same = own[ends == n]
                if n < 32:
                    out[rows[same], j] = _hashes(heads[same, :n]) % np.uint64(BUCKETS)
                else:
                    out[rows[same], j] = [xxhash.xxh64_intdigest(plain[i][:k].encode("utf-8", "surrogatepass"), 1) % BUCKETS for i in rows[same]]
    return out


class Words:
    """Words seen so far: their buckets, their languages and, for a model, their vectors.

    A text is an array of numbers of words. With a model the store holds at most
    CACHE words; ``reset`` says that it began anew, which makes older numbers void.
    """

    def __init__(self, model: Model | None = None):
        self.model = model
        self.languages: dict[str, int] = {}
        for k, words in enumerate(FUNCTION_WORDS.values()):
            for w in words.split():
                self.languages[w] = self.languages.get(w, 0) | 1 << k
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.buckets = np.empty((1024, 1 + len(STEMS)), np.int32)
        self.marks = np.zeros(1024, np.int8)
        self.vectors = np.zeros((1024, 2 * DIM), np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        """Give numbers to the words of a batch of texts."""
        new = set().union(*texts).difference(self.known)
        if self.model is not None and len(self.known) + len(new) > CACHE:
            self.reset()
            new = set().union(*texts)
        if not new:
            return
        first, last = len(self.known), len(self.known) + len(new)
        if last > len(self.marks):
            size = max(last, 2 * len(self.marks))
            self.buckets = np.resize(self.buckets, (size, self.buckets.shape[1]))
            self.marks = np.resize(self.marks, size)
            self.vectors = np.resize(self.vectors, (size, 2 * DIM))
        ordered = sorted(new)
        self.known.update(zip(ordered, range(first, last)))
        for at in range(0, len(ordered), 50_000):
            plain = [_plain(w) for w in ordered[at : at + 50_000]]
            part = slice(first + at, first + at + len(plain))
            self.buckets[part] = word_buckets(plain)
            self.marks[part] = [self.languages.get(w, 0) for w in plain]
        if self.model is not None:
            for at in range(first, last, 50_000):
                part = slice(at, min(at + 50_000, last))
                self.vectors[part] = self.model.vectors(self.buckets[part])

    def codes(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [(t or "").split() for t in texts]
        self.learn(words)
        return [np.fromiter(map(self.known.__getitem__, w), np.int64, len(w)) for w in words]

    def language(self, codes: np.ndarray) -> int:
        """Number of the language with most function words; len(LANGUAGES) if there is none."""
        marks = self.marks[codes]
        marks = marks[marks > 0]
        counts = [int((marks >> k & 1).sum()) for k in range(len(LANGUAGES))]
        return int(np.argmax(counts)) if len(marks) and max(counts) else len(LANGUAGES)


def _activations(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Convolution at every position; kernel is (width, dim, filters); x has width - 1 rows more than positions."""
    n = len(x) - len(kernel) + 1
    out = x[:n] @ kernel[0]
    for k in range(1, len(kernel)):
        out += x[k : k + n] @ kernel[k]
    out += bias
    return out


def pooled(model: Model, words: Words, codes: np.ndarray) -> np.ndarray:
    """Greatest value of each filter over the text, at least 0. Texts are padded by zero vectors at the end."""
    best = np.zeros(FILTERS * len(WIDTHS), np.float32)
    reach = max(WIDTHS) - 1
    for at in range(0, len(codes), PIECE):
        x = words.vectors[codes[at : at + PIECE + reach]]
        if at + PIECE + reach > len(codes):
            x = np.concatenate([x, np.zeros((reach, x.shape[1]), np.float32)])
        for k, (kernel, bias) in enumerate(zip(model.filters, model.biases)):
            values = _activations(x, kernel, bias).max(axis=0)
            np.maximum(best[k * FILTERS : (k + 1) * FILTERS], values, out=best[k * FILTERS : (k + 1) * FILTERS])
    return best


def raw_logits(model: Model, words: Words, texts: list[np.ndarray]) -> np.ndarray:
    """Logits of texts given as codes. Short texts are convolved together, with zero vectors between."""
    out = np.full(len(texts), model.out_bias, np.float64)
    reach = max(WIDTHS) - 1
    group: list[int] = []

    def flush():
        if not group:
            return
        sizes = np.array([len(texts[i]) + reach for i in group])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = np.zeros((int(sizes.sum()) + reach, 2 * DIM), np.float32)
        inner = np.concatenate([np.arange(s, s + len(texts[i])) for s, i in zip(starts, group)])
        x[inner] = words.vectors[np.concatenate([texts[i] for i in group])]
        for k, (kernel, bias) in enumerate(zip(model.filters, model.biases)):
            values = _activations(x, kernel, bias)[: int(sizes.sum())]
            values[~_inside(len(values), inner)] = 0
            best = np.maximum(np.maximum.reduceat(values, starts, axis=0), 0)
            out[group] += best.astype(np.float64) @ model.out[k * FILTERS : (k + 1) * FILTERS]
        group.clear()

    held = 0
    for i, codes in enumerate(texts):
        if len(codes) > PIECE:
            out[i] += pooled(model, words, codes).astype(np.float64) @ model.out
        elif len(codes):
            group.append(i)
            held += len(codes)
            if held > PIECE:
                flush()
                held = 0
    flush()
    return out


def _inside(n: int, inner: np.ndarray) -> np.ndarray:
    mask = np.zeros(n, bool)
    mask[inner] = True
    return mask


def scores(model: Model, words: Words, texts: list[str | None]) -> np.ndarray:
    """Scores of texts, a piece of the list at a time."""
    parts = [np.zeros(0)]
    for at in range(0, len(texts), 256):
        codes = words.codes(texts[at : at + 256])
        shift = model.shifts[[words.language(c) for c in codes]]
        parts.append(1.0 / (1.0 + np.exp(-np.clip(raw_logits(model, words, codes) - shift, -40, 40))))
    return np.concatenate(parts)


def loss_gradients(model: Model, x: np.ndarray, label: float, weight: float) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """(weighted cross-entropy, gradients by parameter, gradient by row of x) of one text.

    ``x`` has the vectors of the words and then max(WIDTHS) - 1 rows of zeros. Max pooling
    sends a gradient to one position a filter only, and to none where that is below 0.
    """
    n = len(x) - max(WIDTHS) + 1
    hidden, where = np.zeros(len(model.out)), []
    for k, (kernel, bias) in enumerate(zip(model.filters, model.biases)):
        values = _activations(x, kernel, bias)[:n]
        at = values.argmax(axis=0) if n else np.zeros(FILTERS, np.int64)
        where.append(at)
        if n:
            hidden[k * FILTERS : (k + 1) * FILTERS] = np.maximum(values[at, np.arange(FILTERS)], 0)
    z = float(np.clip(hidden @ model.out + model.out_bias, -30, 30))
    p = 1 / (1 + np.exp(-z))
    error = weight * (p - label)
    back = error * model.out * (hidden > 0)
    found: dict[str, np.ndarray] = {"out": error * hidden, "bias": np.float64(error)}
    grown = np.zeros_like(x)
    for k, kernel in enumerate(model.filters):
        g = back[k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
        live = np.flatnonzero(g)
        change = np.zeros_like(kernel)
        for w in range(len(kernel)):
            rows = where[k][live] + w
            change[w][:, live] = x[rows].T * g[live]
            np.add.at(grown, rows, (kernel[w][:, live] * g[live]).T)
        found[f"f{k}"], found[f"b{k}"] = change, g
    return weight * float(np.logaddexp(0, z) - label * z), found, grown


@dataclass
class Chunk:
    """Labelled texts as numbers: buckets and language marks of their words, codes with their ends, labels, whether a text is one of the third for the cut-offs."""

    buckets: np.ndarray
    marks: np.ndarray
    codes: np.ndarray
    ends: np.ndarray
    labels: np.ndarray
    third: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i - 1] if i else 0 : self.ends[i]]


def chunk_of(texts: list[str | None], labels: list[int], third: list[bool]) -> Chunk:
    words = Words()
    codes = [c.astype(np.int32) for at in range(0, len(texts), 64) for c in words.codes(texts[at : at + 64])]
    n = len(words.known)
    ends = np.cumsum([len(c) for c in codes], dtype=np.int64)
    return Chunk(words.buckets[:n], words.marks[:n], np.concatenate(codes), ends, np.array(labels, np.int8), np.array(third, bool))


#: Rows of a state: words, beginnings, then the dense weights in rows of DIM.
N_DENSE = -(-(sum(WIDTHS) * 2 * DIM * FILTERS + 2 * FILTERS * len(WIDTHS) + 1) // DIM)
FIRST_DENSE = 2 * BUCKETS


class State:
    """Weights in training, as rows of DIM numbers, with Adagrad's sums: one for each row of the tables, one for each dense weight."""

    def __init__(self, rows: np.ndarray, sums: np.ndarray, dense_sums: np.ndarray):
        self.rows, self.sums, self.dense_sums = rows, sums, dense_sums
        self.dense = rows[FIRST_DENSE:].reshape(-1)  # a view

    @classmethod
    def new(cls, seed: int = 7) -> State:
        rng = np.random.default_rng(seed)
        rows = np.zeros((FIRST_DENSE + N_DENSE, DIM), np.float32)
        rows[:BUCKETS] = rng.normal(0, 0.3, (BUCKETS, DIM))
        rows[BUCKETS:FIRST_DENSE] = rng.normal(0, 0.1, (BUCKETS, DIM))
        state = cls(rows, np.full(FIRST_DENSE, 1e-4, np.float32), np.full(N_DENSE * DIM, 1e-4, np.float32))
        filters, _, out = state.parts(state.dense)
        for w, f in zip(WIDTHS, filters):
            f[:] = rng.normal(0, 0.5 / np.sqrt(2 * DIM * w), f.shape)
        out[:-1] = rng.normal(0, 0.2, len(out) - 1)
        return state

    def copy(self) -> State:
        return State(self.rows.copy(), self.sums.copy(), self.dense_sums.copy())

    @staticmethod
    def parts(dense: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(filters, biases of all, output weights and then their bias) as views."""
        filters, at = [], 0
        for w in WIDTHS:
            n = w * 2 * DIM * FILTERS
            filters.append(dense[at : at + n].reshape(w, 2 * DIM, FILTERS))
            at += n
        n = FILTERS * len(WIDTHS)
        return filters, dense[at : at + n], dense[at + n : at + 2 * n + 1]

    def model(self) -> Model:
        filters, biases, out = self.parts(self.dense)
        stems = np.concatenate([self.rows[BUCKETS:FIRST_DENSE], np.zeros((1, DIM), np.float32)])
        return Model(self.rows[:BUCKETS].copy(), stems, [f.copy() for f in filters], [b.copy() for b in biases.reshape(len(WIDTHS), -1)], out[:-1].astype(np.float64), float(out[-1]))


def batch_gradients(state: State, chunk: Chunk, batch: list[int], weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense gradient, rows of the tables, their gradients), summed over texts as ``loss_gradients`` has them."""
    filters, biases, out = State.parts(state.dense)
    texts = [chunk.text(i) for i in batch]
    used = np.zeros(len(chunk.marks), bool)
    for t in texts:
        used[t] = True
    used = np.flatnonzero(used)
    place = np.empty(len(chunk.marks), np.int32)
    place[used] = np.arange(len(used))
    stem_rows = chunk.buckets[used, 1:]
    rows = np.concatenate([chunk.buckets[used, :1], BUCKETS + stem_rows], axis=1)
    x = np.zeros((len(used) + 1, 2 * DIM), np.float32)  # the last row is the padding
    for at in range(0, len(used), 50_000):
        part = slice(at, min(at + 50_000, len(used)))
        x[part, :DIM] = state.rows[rows[part, 0]]
        # A word without a beginning of some length points at a dense row, whose numbers are left out.
        x[part, DIM:] = (state.rows[rows[part, 1:]] * (stem_rows[part] < BUCKETS)[:, :, None]).sum(axis=1)
    # Products of each word and each row of a filter; those of very many words are made a piece at a time.
    few = len(used) <= 2 * PIECE
    made = [[np.ascontiguousarray((x @ kernel[w]).T) for w in range(len(kernel))] if few else None for kernel in filters]
    reach, n_out = max(WIDTHS) - 1, len(out) - 1
    hidden, where = np.zeros((len(batch), n_out), np.float32), np.zeros((len(batch), n_out), np.int64)
    for d, t in enumerate(texts):
        best = np.full(n_out, -np.inf, np.float32)
        for at in range(0, len(t), PIECE):
            own = place[t[at : at + PIECE + reach]]
            n = min(PIECE, len(t) - at)
            own = np.concatenate([own, np.full(n + reach - len(own), len(used), own.dtype)])
            for k, kernel in enumerate(filters):
                if few:
                    values = made[k][0].take(own[:n], axis=1)
                    for w in range(1, len(kernel)):
                        values += made[k][w].take(own[w : w + n], axis=1)
                else:
                    values = _activations(x[own], kernel, np.float32(0))[:n].T
                top = values.argmax(axis=1)
                value = values[np.arange(FILTERS), top]
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                better = value > best[part]
                best[part][better] = value[better]
                where[d, part][better] = top[better] + at
        if len(t):
            hidden[d] = np.maximum(best + biases, 0)
    labels = chunk.labels[batch]
    z = np.clip(hidden @ out[:-1] + out[-1], -30, 30)
    error = np.where(labels == 1, weights[1], weights[0]) * (1 / (1 + np.exp(-z)) - labels)
    back = (error[:, None] * out[:-1] * (hidden > 0)).astype(np.float32)
    dense = np.zeros_like(state.dense)
    grown_filters, grown_biases, grown_out = State.parts(dense)
    grown_out[:-1], grown_out[-1] = error @ hidden, error.sum()
    grown_biases[:] = back.sum(axis=0)
    ids, found = [], []
    for k, kernel in enumerate(filters):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        g = back[:, part]
        for w in range(len(kernel)):
            at = np.full((len(batch), FILTERS), len(used))
            for d, t in enumerate(texts):
                rows_at = where[d, part] + w
                inside = rows_at < len(t)
                at[d, inside] = place[t[rows_at[inside]]]
            grown_filters[k][w] = np.einsum("dfi,df->if", x[at], g)
            live = (g != 0) & (at < len(used))
            ids.append(at[live])
            found.append((kernel[w].T[None] * g[:, :, None])[live])
    ids, grown = _summed(np.concatenate(ids), np.concatenate(found))
    heads, head_grown = _summed(rows[ids, 0], grown[:, :DIM])
    live = stem_rows[ids] < BUCKETS
    tails, tail_grown = _summed(rows[ids, 1:][live], np.repeat(grown[:, DIM:], live.sum(axis=1), axis=0))
    return dense, np.concatenate([heads, tails]), np.concatenate([head_grown, tail_grown])


def _summed(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different ids, their values' sums)."""
    if not len(ids):
        return ids, values
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[first], np.add.reduceat(values[order], first, axis=0)


def train(state: State, chunk: Chunk, chosen: np.ndarray, weights: tuple[float, float], epochs: int, seed: int, rate: float = RATE) -> None:
    """Adagrad over the chosen texts of a chunk, a few at a time; changes the state."""
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(chosen)
        # A step ends after BATCH texts, or sooner after many words.
        upto, at = np.cumsum(np.diff(chunk.ends, prepend=0)[order]), 0
        while at < len(order):
            far = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * PIECE, "right"))
            batch = order[at : min(at + BATCH, max(far, at + 1))].tolist()
            at += len(batch)
            dense, rows, grown = batch_gradients(state, chunk, batch, weights)
            dense += 1e-4 * len(batch) * state.dense
            state.dense_sums += dense * dense
            state.dense -= rate * dense / np.sqrt(state.dense_sums)
            state.sums[rows] += (grown * grown).mean(axis=1)
            state.rows[rows] -= rate * grown / np.sqrt(state.sums[rows])[:, None]


def best_cut(z: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the widest best-F1 gap between logits ``z``, each with its numbers of texts and of toxic ones."""
    order = np.argsort(-z, kind="stable")
    z, count, toxic = z[order], count[order], toxic[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(count) + toxic.sum())
    after = np.append(z[1:], z[-1] - 1)
    k = int(np.argmax(f1 + 1e-6 * np.minimum(z - after, 10)))
    return float((z[k] + after[k]) / 2)


def cut_offs(spoken: np.ndarray, z: np.ndarray, count: np.ndarray, toxic: np.ndarray, least: int = 30) -> np.ndarray:
    """Cut-offs by language from counts at different logits; one with fewer than ``least`` texts of either label keeps that of all."""
    shifts = np.zeros(len(LANGUAGES) + 1)
    if not 0 < toxic.sum() < count.sum():
        return shifts
    values, at = np.unique(z, return_inverse=True)
    shifts[:] = best_cut(values, np.bincount(at, count), np.bincount(at, toxic))
    for k in range(len(LANGUAGES)):
        own = spoken == k
        if min(toxic[own].sum(), (count - toxic)[own].sum()) >= least:
            shifts[k] = best_cut(z[own], count[own], toxic[own])
    return shifts


def held_out(doc_id) -> F.Column:
    """Whether a document is left out of the fit: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks of all labelled texts that are not held out, one a row.

    A doc_id with several texts counts with the least of them, one with both labels as
    toxic. Texts go to partitions by doc_id and are ordered there, so that chunks are the
    same in each run.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = stage(known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    parts = -(-known.count() // CHUNK_ROWS) or 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    # Texts of other ids are left out before any is shuffled.
    texts = parted_by(texts, known, "doc_id")[0]
    # Not a join, which would deal its sides out by a number of partitions of its own.
    both = texts.withColumns({"toxic": F.lit(None).cast("int"), "there": F.lit(True)}).unionByName(known.withColumn("there", F.lit(False)), allowMissingColumns=True)
    both = both.repartition(parts, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"), F.max("there").alias("there"))
    both = both.where("there AND toxic IS NOT NULL")
    third = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    both = both.select("text", "toxic", third.alias("third"), F.xxhash64("doc_id").alias("place"), "doc_id").sortWithinPartitions("place", "doc_id")
    # A row is some megabytes, so writers look at their sizes after each.
    sizes = {f"parquet.{unit}.size.row.check.min": 1 for unit in ("page", "block")}
    return stage(small_batches(both).mapInArrow(_packed, ", ".join(_PACKED)), "chunks", **sizes)


_PACKED = ("fit long", "fit_toxic long", "n long", "toxic long", *(f"{c} binary" for c in ("buckets", "stems", "marks", "codes", "ends", "labels", "third")))


def _packed(batches):
    texts, labels, third, held_bytes = [], [], [], 0

    def row():
        c = chunk_of(texts, labels, third)
        seen = c.labels[~c.third]
        stems = (c.buckets[:, 1:] < BUCKETS).sum(axis=1).astype(np.uint8)
        arrays = (c.buckets.astype(np.uint16), stems, c.marks, c.codes, c.ends, c.labels, c.third)
        values = [len(seen), int(seen.sum()), len(c.labels), int(c.labels.sum()), *(a.tobytes() for a in arrays)]
        types = [pa.int64()] * 4 + [pa.binary()] * 7
        for part in (texts, labels, third):
            part.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[p.split()[0] for p in _PACKED])

    for batch in batches:
        for piece in pieces(batch):
            sizes = pc.fill_null(pc.binary_length(piece.column("text")), 0).to_pylist()
            for text, toxic, apart, size in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist(), piece.column("third").to_pylist(), sizes):
                if texts and held_bytes + size > CHUNK_BYTES:
                    yield row()
                    held_bytes = 0
                texts.append(text)
                labels.append(toxic)
                third.append(apart)
                held_bytes += size
    if texts:
        yield row()


def _unpacked(batches) -> Iterator[Chunk]:
    for batch in batches:
        for r in batch.to_pylist():
            buckets = np.frombuffer(r["buckets"], np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int32)
            buckets[:, 1:][np.arange(len(STEMS)) >= np.frombuffer(r["stems"], np.uint8)[:, None]] = BUCKETS
            rest = ((np.int8, "marks"), (np.int32, "codes"), (np.int64, "ends"), (np.int8, "labels"), (bool, "third"))
            yield Chunk(buckets, *(np.frombuffer(r[c], t) for t, c in rest))


#: Shares of the changes are added up as integers of this unit, each number within LARGEST.
UNIT, LARGEST = 2.0**36, 1e8
_CHANGES = ("id int", "weight long", "square long", *(f"d{k} long" for k in range(DIM)))


def _fetched(few: DataFrame, spark: SparkSession) -> pa.Table:
    """Rows of bounded number, read by ``spark``, since a session of one row a batch would send each alone."""
    path = write(few, "few")
    forget(spark, path)
    return spark.read.schema(few.schema).parquet(path).toArrow()


def _round(chunks: DataFrame, state: State, n: int, weights: tuple[float, float], epochs: int, seed: int, everything: bool) -> State:
    """The state after each chunk has trained on its own texts; ``n`` is the number of all of them.

    A row of the tables moves by the mean over the chunks that have changed it.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(state)  # a few MB, whatever the input

    def run(batches):
        begin, total = shared.value, None
        for chunk in _unpacked(batches):
            chosen = np.arange(len(chunk.labels)) if everything else np.flatnonzero(~chunk.third)
            if not len(chosen):
                continue
            own = begin.copy()
            train(own, chunk, chosen, weights, epochs, seed)
            whole = lambda v: np.rint(np.clip(v, -LARGEST, LARGEST) * (len(chosen) / n * UNIT)).astype(np.int64)
            if total is None:
                total = np.zeros((FIRST_DENSE + 2 * N_DENSE, 2 + DIM), np.int64)
            hit = np.append(np.flatnonzero(own.sums != begin.sums), np.arange(FIRST_DENSE, len(total)))
            total[hit, 0] += int(whole(1.0))
            total[:FIRST_DENSE, 1] += whole(own.sums.astype(np.float64) - begin.sums)
            total[: FIRST_DENSE + N_DENSE, 2:] += whole(own.rows.astype(np.float64) - begin.rows)
            total[FIRST_DENSE + N_DENSE :, 2:] += whole(own.dense_sums.astype(np.float64) - begin.dense_sums).reshape(-1, DIM)
        if total is not None:
            hit = np.flatnonzero(total[:, 0])
            for at in range(0, len(hit), 10_000):
                part = hit[at : at + 10_000]
                columns = [pa.array(part, pa.int32()), *(pa.array(np.ascontiguousarray(total[part, k])) for k in range(total.shape[1]))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CHANGES])

    changes = small_batches(chunks, 1).mapInArrow(run, ", ".join(_CHANGES))
    sums = changes.groupBy("id").agg(*(F.sum(c.split()[0]).alias(c.split()[0]) for c in _CHANGES[1:]))
    # At most as many rows as the model has.
    found = _fetched(sums.select("id", *((F.col(c.split()[0]) / F.col("weight")).cast("float").alias(c.split()[0]) for c in _CHANGES[2:])), chunks.sparkSession)
    shared.destroy()
    total = np.zeros((FIRST_DENSE + 2 * N_DENSE, 1 + DIM))
    for k, c in enumerate(_CHANGES[2:]):
        total[found.column("id").to_numpy(), k] = found.column(c.split()[0]).to_numpy()
    return State(
        (state.rows + total[: FIRST_DENSE + N_DENSE, 1:]).astype(np.float32),
        (state.sums + total[:FIRST_DENSE, 0]).astype(np.float32),
        (state.dense_sums + total[FIRST_DENSE + N_DENSE :, 1:].reshape(-1)).astype(np.float32),
    )


def _calibrated(chunks: DataFrame, model: Model) -> np.ndarray:
    """Cut-offs from all texts of the third; logits are counted in steps of 1/1024."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, words = shared.value, Words()
        for chunk in _unpacked(batches):
            words.marks, words.vectors = chunk.marks, np.concatenate([np.zeros((0, 2 * DIM), np.float32), *(model.vectors(chunk.buckets[at : at + 50_000]) for at in range(0, len(chunk.buckets), 50_000))])
            own = np.flatnonzero(chunk.third)
            texts = [chunk.text(i) for i in own]
            steps = np.floor(np.clip(raw_logits(model, words, texts), -40, 40) * 1024).astype(np.int32)
            spoken = np.array([words.language(t) for t in texts], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spoken), pa.array(steps), pa.array(chunk.labels[own].astype(np.int32))], names=["spoken", "step", "toxic"])

    rows = small_batches(chunks, 1).mapInArrow(run, "spoken int, step int, toxic int")
    # At most 81,921 steps of each language.
    found = rows.groupBy("spoken", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    found = _fetched(found, chunks.sparkSession).sort_by([("spoken", "ascending"), ("step", "ascending")])
    shared.destroy()
    spoken, step, count, toxic = (found.column(c).to_numpy() for c in ("spoken", "step", "n", "toxic"))
    return cut_offs(spoken, (step + 0.5) / 1024, count, toxic)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of all labelled rows that are not held out.

    Where only one label is among the two thirds for the weights, all rows give these and
    no cut-offs are set; where it is the only one at all, every text gets its share.
    """
    with scope(docs.sparkSession):
        chunks = labelled(docs, labels)
        r = chunks.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("fit", "fit_toxic", "n", "toxic"))).head()
        n_chunks, seen, seen_toxic, n, toxic = r
        if not 0 < toxic < n:
            return Model(out_bias=float(np.log((toxic + 0.5) / (n - toxic + 0.5))))
        everything = not 0 < seen_toxic < seen
        if everything:
            seen, seen_toxic = n, toxic
        share, times = seen_toxic / seen, min(MOST, max(FEWEST, LEAST_STEPS // seen))
        # One chunk needs no averages, so it is gone through at once.
        rounds, epochs = (1, times) if n_chunks == 1 else (times, 1)
        state = State.new()
        for k in range(rounds):
            state = _round(chunks, state, seen, (0.5 / (1 - share), 0.5 / share), epochs, k, everything)
        model = state.model()
        if not everything:
            model.shifts = _calibrated(chunks, model)
        return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of no words. Repeated rows come back repeated,
    a null doc_id stays null and is not held out, an empty table gives no rows. Only
    doc_id and text are read, so columns named like the results don't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    name = model.name

    def start():
        model = shared.value
        words = held(("toxicity", name), lambda: Words(model))
        return lambda texts: [scores(model, words, texts)]

    out = per_text(docs, {"score": pa.float64()}, start)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all rows.

    Labels with a null doc_id or of other values than 0 and 1 are not used; a document
    that has both counts as toxic. Without rows of both labels every text gets one score.
    For documents see ``score``.
    """
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not predict toxic, with all their columns.

    Rows are judged by their text alone, as ``score`` does; ids, repeats and the names of
    other columns don't matter, and an empty table stays empty.
    """
    model = fit(docs, labels)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), model.name

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = held(("toxicity", name), lambda: Words(shared.value))
        for b in batches:
            yield pd.Series(scores(shared.value, words, b.tolist()))

    return small_batches(docs).where(scored(F.col("text").cast("string")) < 0.5)
