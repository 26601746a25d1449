"""Token ids as binary shards with Elias-Fano document boundaries.

A shard is one file::

    magic "TWIDS1", u8 id width (2 or 4), u8 0, u64 number of documents, u64 number of ids
    Elias-Fano block of the documents' ends in the id array (last = number of ids)
    Elias-Fano block of doc_id - least doc_id, preceded by i64 least doc_id
    ids, little-endian, one after the other

A null doc_id is kept in a shard of its own kind, marked by the byte after the
width. An Elias-Fano block of n numbers up to u holds about n (2 + log2(u / n))
bits: the low l = floor(log2(u / n)) bits of each number side by side, the rest in
unary as a bit vector, and the position of every 256th one, from which ``select``
finds a number without a table of 64-bit offsets.

Documents are ranged over the shards by doc_id, so the order of the files is that
of the ids. The files go to the folder that all executors share, each under a name
of its own attempt; the manifest, which is written with the task's output, names
the files of the attempts that counted.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.bpe import byte_letters
from tarnwell.llm.common import Store, forget, held, open_in, open_out, pieces, shared_dir, small_batches, stage

MAGIC = b"TWIDS1"
SAMPLE = 256
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Words that an encoder keeps in each of two generations.
CACHE = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class EliasFano:
    """A non-decreasing sequence of numbers >= 0 in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() if low_bits else np.empty(0, np.uint8)
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, source) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack("<QBQQQ", source.read(33))
        low, high = np.frombuffer(source.read(a), np.uint8), np.frombuffer(source.read(b), np.uint8)
        return cls(n, low_bits, low, high, np.frombuffer(source.read(4 * c), "<u4"))

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        at = first * self.low_bits
        end = at + count * self.low_bits
        bits = np.unpackbits(self.low[at // 8 : (end + 7) // 8], bitorder="little")[at % 8 : at % 8 + end - at]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def block(self, number: int) -> np.ndarray:
        """Numbers number * SAMPLE and on, up to SAMPLE of them, as 64 bits (from 2 ** 63 on they look negative)."""
        first = number * SAMPLE
        count = min(SAMPLE, self.n - first)
        start = int(self.samples[number])
        stop = int(self.samples[number + 1]) if number + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : (stop + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits)[: SAMPLE + 8] + start // 8 * 8
        ones = ones[ones >= start][:count]
        return ((ones - np.arange(first, first + count)) << self.low_bits) | self._lows(first, count)

    def select(self, k: int) -> int:
        """Number k, counted from 0."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        return int(self.block(k // SAMPLE)[k % SAMPLE]) % (1 << 64)

    def blocks(self):
        for number in range(len(self.samples)):
            yield self.block(number)


class ByteEncoder:
    """Ids of texts as the tokenizers library gives them, with a store of encoded words.

    A byte-level vocabulary splits a text before a space that stands between words,
    whatever is around, so a text's ids are those of its space-led words one after
    the other, and a word's those of the runs that its pre-tokenizer cuts it into.
    The library's model encodes each different word once. Texts where a space has white
    space before it and white space or the text's end after it, and those with a special
    token's string, go through the library whole; so do all texts with a vocabulary
    that isn't of this kind.
    """

    _WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    _TIED = re.compile(r"\s (?:\s|\Z)")
    #: Letters below this have long been letters in every Unicode table.
    _LATIN_END = "\u0250"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype, self.packed = f"<u{self.width}", "<%d" + ("H" if self.width == 2 else "I")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        self.by_words = spec["normalizer"] is None and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
        if self.by_words:
            self.model, self.runs = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = dict(enumerate(byte_letters()))
        self.before_space = [w + " " for w in self._WHITE]
        self.tails = Store(self._run, 10_000)
        self.spaced, self.bare = Store(self._spaced, CACHE), Store(self._bare, CACHE // 4)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids(self, letters: str) -> bytes:
        """Ids of one run, given as the letters that stand for its bytes."""
        ids = [t.id for t in self.model(letters)]
        return struct.pack(self.packed % len(ids), *ids)

    def _run(self, run: str) -> bytes:
        return self._ids(run.encode().decode("latin-1").translate(self.letters))

    def _cut(self, text: str) -> bytes:
        return b"".join([self._ids(letters) for letters, _ in self.runs(text)])

    def _one_kind(self, body: str) -> bool:
        """Whether a word holds nothing but letters, or but digits, by every Unicode table."""
        return body.isalpha() and (body.isascii() or max(body) < self._LATIN_END) or body.isascii() and body.isdigit()

    def _spaced(self, word: str) -> bytes:
        """Ids of a word behind a space."""
        return self._word(" ", word, self.spaced)

    def _bare(self, word: str) -> bytes:
        return self._word("", word, self.bare)

    def _word(self, lead: str, word: str, store: Store) -> bytes:
        """Letters, or digits, are one run; so is the punctuation after them, and a line end between words."""
        body = word.rstrip(string.punctuation)
        if not body or len(body) == len(word) and self._one_kind(body):
            return self._run(lead + word)
        if self._one_kind(body):
            return store[body] + self.tails[word[len(body) :]]
        first, line_end, rest = word.partition("\n")
        if first and rest and not first[-1].isspace() and not rest[0].isspace():
            return store[first] + self.tails[line_end] + self.bare[rest]
        return self._cut(lead + word)

    def _is_tied(self, text: str) -> bool:
        return any(w in text for w in self.before_space) and bool(self._TIED.search(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes; none for null."""
        out: list[bytes] = []
        ids = self.spaced.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.by_words or any(s in text for s in self.special) or self._is_tied(text):
                out.append(self._whole(text))
            else:
                words = iter(text.split(" "))
                out.append(self.bare[next(words)] + b"".join(map(ids, words)))
        return out


@dataclass
class Shard:
    """A shard opened for reading."""

    source: object
    width: int
    null_ids: bool
    n_docs: int
    n_ids: int
    ends: EliasFano
    least: int
    ids: EliasFano
    base: int

    @classmethod
    def open(cls, path: str) -> Shard:
        source = open_in(path)
        if source.read(6) != MAGIC:
            raise ValueError(f"{path} is no shard")
        width, null_ids, n_docs, n_ids = struct.unpack("<BBQQ", source.read(18))
        ends = EliasFano.read(source)
        (least,) = struct.unpack("<q", source.read(8))
        return cls(source, width, bool(null_ids), n_docs, n_ids, ends, least, EliasFano.read(source), source.tell())

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, exclusive."""
        self.source.seek(self.base + start * self.width)
        return np.frombuffer(self.source.read((end - start) * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        return self.read(*self.span(k))

    def documents(self):
        """(doc_id, ids) of each document in order, holding one block of documents at a time."""
        at = 0
        for ends, ids in zip(self.ends.blocks(), self.ids.blocks()):
            held = self.read(at, int(ends[-1]))
            starts = np.concatenate([[at], ends[:-1]]) - at
            for doc, s, e in zip(ids, starts, ends - at):
                yield (None if self.null_ids else int(doc) % (1 << 64) + self.least), held[s:e]
            at = int(ends[-1])


def _write_shard(path: str, doc_ids: list[int], null_ids: bool, blobs: list[bytes], encoder: ByteEncoder) -> int:
    ends = np.cumsum([len(b) // encoder.width for b in blobs], dtype=np.int64)
    least = 0 if null_ids else int(doc_ids[0])
    offsets = np.zeros(len(doc_ids), np.uint64) if null_ids else (np.array(doc_ids, np.int64).view(np.uint64) - np.int64(least).view(np.uint64))
    with open_out(path) as out:
        out.write(MAGIC + struct.pack("<BBQQ", encoder.width, null_ids, len(blobs), int(ends[-1])))
        out.write(EliasFano.of(ends).to_bytes())
        out.write(struct.pack("<q", least) + EliasFano.of(offsets).to_bytes())
        for b in blobs:
            out.write(b)
    return int(ends[-1])


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode and write all documents; the manifest: shard, part, path, n_docs, n_ids, start.

    Shards are in ascending doc_id order, nulls first, repeated ids by a hash of the text; ``start``
    is the number of ids before the shard. A task closes a file at ``shard_bytes`` of
    ids and begins the next ``part``, so its memory is bounded by that and one text.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tarnwell-ids-{uuid.uuid4().hex}"
    path = path or vocabulary_path()

    def run(batches):
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        encoder, end = None, b""
        ids: list[int] = []
        blobs: list[bytes] = []
        kept, null_ids = 0, False

        def close():
            nonlocal part, kept
            name = f"{folder}/ids-{shard:06d}-{part:04d}-{uuid.uuid4().hex[:8]}.twids"
            row = [shard], [part], [name], [len(blobs)], [_write_shard(name, ids, null_ids, blobs, encoder)]
            part, kept = part + 1, 0
            ids.clear()
            blobs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _MANIFEST)], schema=_MANIFEST)

        for batch in batches:
            if encoder is None:
                encoder = held(("token_store", path), lambda: ByteEncoder(path))
                end = np.array([end_id], encoder.dtype).tobytes()
            for piece in pieces(batch):
                for doc, blob in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text").to_pylist())):
                    if blobs and (kept >= shard_bytes or (doc is None) != null_ids):
                        yield close()
                    null_ids = doc is None
                    ids.append(doc or 0)
                    blobs.append(blob + end)
                    kept += len(blob) + len(end)
        if blobs:
            yield close()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    # At least some tasks for each core, and at most about 64 MB of text in each.
    n = int(max(size >> 26, min((size >> 20) + 1, 4 * spark.sparkContext.defaultParallelism)))
    # Rows of one id, or of none, are dealt on by a hash of their text.
    keys = ["blank", "doc_id", "of_text"]
    ranged = slim.withColumns({"blank": F.col("doc_id").isNotNull(), "of_text": F.xxhash64("text")})
    ranged = ranged.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    manifest = stage(small_batches(ranged).mapInArrow(run, "shard int, part int, path string, n_docs long, n_ids long"), "manifest")
    # One row for each file.
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for file, at in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                out: list[tuple] = []
                for doc, ids in Shard.open(file).documents():
                    out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


_MANIFEST = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names)


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents and read the files back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text holds the end id alone; null doc_ids come first; rows of one
    doc_id follow one another, ordered by a hash of the text; an empty table has no
    file and gives no rows. Only doc_id and text are read. The files are deleted with
    the open scope, or else when the application ends.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tarnwell-ids-{uuid.uuid4().hex}"
    forget(spark, folder)
    return read(write(docs, folder, path))
