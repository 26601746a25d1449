"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is what the merges give if and only if every two neighbours
are: merging the bytes of the two alone gives these two back. So each prefix of a
word's bytes has exactly one valid last token: the one token ending there that
goes with the last token of the prefix before it. A table holds that token for
every prefix. A longer word extends the table; after an edit it is filled again
from the edit on, until as many entries as the longest token has bytes agree with
the old table, from where on all do.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Store, held, per_text, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks of text, and words, that a worker keeps in each of two generations.
CACHE = 400_000
#: Pairs of tokens that it keeps in each of two generations.
PAIRS = 300_000
# The white space of Unicode.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts a text only where every match of the vocabulary's pattern is cut: before a space and a
#: word's first character, and around the rest of longer white space.
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The pattern of the rank files, with the white space of Unicode named."""
    import public_tokenizers

    found = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_WHITE}")
    return found.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")


class Vocabulary:
    """Tokens by rank, found by their last bytes, and which of them may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.longest = max(map(len, self.tokens))
        self.lengths = list(map(len, self.tokens))
        # Finds every token that ends at a byte, the longest first; bytes are letters of Latin-1 to it.
        self.ends = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), i)
        self.ends.make_automaton()
        self.pairs = Store(self._together, PAIRS)

    def pair(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand after ``before``, or at the beginning if that is -1."""
        return self.pairs[before, token]

    def merge(self, word: bytes) -> list[int]:
        """The merges as they are defined: the least rank first, the leftmost of equal ones."""
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            found = [ranks.get(a + b, self.size) for a, b in zip(parts, parts[1:])]
            least = min(found)
            if least == self.size:
                break
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def _together(self, pair: tuple[int, int]) -> bool:
        before, token = pair
        if before < 0:
            return self.merge(self.tokens[token]) == [token]
        both = self.tokens[before] + self.tokens[token]
        own = self.ranks.get(both)
        if own is not None and self.pair(-1, own):
            return False
        return self.merge(both) == [before, token]


class PrefixTable:
    """The last token of every prefix of a word's bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def copy(self) -> PrefixTable:
        other = PrefixTable(self.vocabulary)
        other.data, other.last = bytearray(self.data), list(self.last)
        return other

    def _fill(self, begin: int, done=None) -> int:
        """Entries from the prefix of ``begin`` bytes on, until ``done`` says so of one; the number of them."""
        v, last = self.vocabulary, self.last
        pairs, lengths = v.pairs, v.lengths
        low = max(0, begin - v.longest)
        at = begin - 1 - low
        for end, token in v.ends.iter(self.data[low:].decode("latin-1")):
            if end != at:
                if end > at:
                    break
            elif pairs[last[low + 1 + end - lengths[token]], token]:
                last.append(token)
                at += 1
                if done is not None and done(low + at):
                    return low + at - begin + 1
        if len(last) <= len(self.data):
            raise ValueError("the vocabulary does not have every byte")
        return len(last) - begin

    def append(self, data: bytes) -> None:
        """The word goes on; what is known of it stays."""
        begin = len(self.data)
        self.data += data
        self._fill(begin + 1)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of the bytes from ``start`` to ``end``; the number of entries that were filled anew."""
        old, moved = self.last, len(data) - (end - start)
        self.data[start:end] = data
        self.last = old[: start + 1]
        clear, equal = start + len(data), 0

        def done(i: int) -> bool:
            nonlocal equal
            equal = equal + 1 if i >= clear and self.last[i] == old[i - moved] else 0
            if equal < self.vocabulary.longest:
                return False
            self.last += old[i - moved + 1 :]
            return True

        return self._fill(start + 1, done)

    def ids(self) -> list[int]:
        found, i = [], len(self.data)
        while i:
            found.append(self.last[i])
            i -= self.vocabulary.lengths[self.last[i]]
        return found[::-1]


class Encoder:
    """Encoder and decoder of a rank file."""

    def __init__(self, path: str, split: str | None = None):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(split or pattern())
        self.chunks, self.words = Store(self._chunk, CACHE), Store(self._names, CACHE)
        # Ids are kept as they are hashed, each after a comma.
        self.by_name = {b"%d" % i: token for i, token in enumerate(self.vocabulary.tokens)}

    def word(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern: a token of its own, or what its table says."""
        own = self.vocabulary.ranks.get(word)
        return [own] if own is not None else PrefixTable(self.vocabulary, word).ids()

    def _names(self, word: str) -> bytes:
        return b"".join([b",%d" % i for i in self.word(word.encode())])

    def _chunk(self, chunk: str) -> bytes:
        # A letter run after a space is one match.
        if chunk.isascii() and chunk.removeprefix(" ").isalpha():
            return self.words[chunk]
        return b"".join(map(self.words.__getitem__, self.split.findall(chunk)))

    def names(self, text: str | None) -> bytes:
        """The decimal ids, joined by commas."""
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text or "")))[1:]

    def encode(self, text: str | None) -> list[int]:
        names = self.names(text)
        return list(map(int, names.split(b","))) if names else []

    def decode(self, ids) -> bytes:
        return b"".join([self.vocabulary.tokens[i] for i in ids])

    def decode_names(self, names: bytes) -> bytes:
        return b"".join(map(self.by_name.__getitem__, names.split(b","))) if names else b""


class TextTable:
    """A text as matches of the pattern, each with its table, that can be added to and edited.

    A match depends on the text from its start to one character after its end, or two
    where that end is the text's, so only the matches near an edit are looked for again.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.spans: list[tuple[int, int]] = [m.span() for m in encoder.split.finditer(text)]
        self.tables: list[PrefixTable | None] = [None] * len(self.spans)

    def _table(self, k: int) -> PrefixTable:
        if self.tables[k] is None:
            start, end = self.spans[k]
            self.tables[k] = PrefixTable(self.encoder.vocabulary, self.text[start:end].encode())
        return self.tables[k]

    def edited(self, start: int, end: int, new: str) -> TextTable:
        """This text with the characters from ``start`` to ``end`` replaced; this one stays."""
        text = self.text[:start] + new + self.text[end:]
        moved = len(new) - (end - start)
        # The matches that end two characters or more before the edit stay.
        keep = bisect_left(self.spans, start - 1, key=lambda span: span[1])
        at = self.spans[keep - 1][1] if keep else 0
        spans, tables = self.spans[:keep], self.tables[:keep]
        k = keep
        for m in self.encoder.split.finditer(text, at):
            begin = m.start()
            while k < len(self.spans) and self.spans[k][0] + moved < begin:
                k += 1
            if begin >= start + len(new) and k < len(self.spans) and self.spans[k][0] + moved == begin and self.spans[k][0] >= end:
                spans += [(a + moved, b + moved) for a, b in self.spans[k:]]
                tables += self.tables[k:]
                break
            spans.append(m.span())
            tables.append(self._reused(m.span(), text, start, end, moved))
        other = TextTable.__new__(TextTable)
        other.encoder, other.text, other.spans, other.tables = self.encoder, text, spans, tables
        return other

    def _reused(self, span: tuple[int, int], text: str, start: int, end: int, moved: int) -> PrefixTable | None:
        """The table of a match around the edit, made from that of the old match at its place."""
        k = bisect_left(self.spans, (span[0],))
        if k >= len(self.spans) or self.spans[k][0] != span[0]:
            return None
        old_end = self.spans[k][1]
        if not span[0] <= start <= end <= old_end or span[1] - moved != old_end:
            return None
        table = self._table(k).copy()
        before = len(self.text[span[0] : start].encode())
        table.replace(before, before + len(self.text[start:end].encode()), text[start : end + moved].encode())
        return table

    def append(self, more: str) -> TextTable:
        return self.edited(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        ranks, found = self.encoder.vocabulary.ranks, []
        for k, (start, end) in enumerate(self.spans):
            own = ranks.get(self.text[start:end].encode())
            found += [own] if own is not None else self._table(k).ids()
        return found


def _encoder(path: str) -> Encoder:
    return held(("prefix_bpe", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array of int), n_tokens.

    Null and empty texts have no token. Repeated rows come back repeated, a null
    doc_id stays null, an empty table gives no rows. Only doc_id and text are read,
    so columns named like the results don't clash.
    """
    path = path or vocabulary_path()

    def rows(texts):
        ids = [_encoder(path).encode(t) for t in texts]
        return [ids, [len(i) for i in ids]]

    return per_text(docs, {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}, lambda: rows)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, lossless.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes
    that they decode to; lossless says whether these are the text's. Null and empty
    texts have no token. Repeated rows come back repeated, a null doc_id stays null,
    an empty table gives no rows. Only doc_id and text are read, so columns named
    like the results don't clash.
    """
    path = path or vocabulary_path()

    def rows(texts):
        encoder, out = _encoder(path), ([], [], [], [])
        for text in texts:
            names = encoder.names(text)
            plain = encoder.decode_names(names)
            out[0].append(names.count(b",") + 1 if names else 0)
            out[1].append(hashlib.sha256(names).hexdigest())
            out[2].append(hashlib.sha256(plain).hexdigest())
            out[3].append(plain == (text or "").encode())
        return list(out)

    return per_text(docs, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "lossless": pa.bool_()}, lambda: rows)


def encode_edits(docs: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """The ids of every edited version: doc_id, edit_id, ids, n_tokens, one row per edit.

    ``docs`` has doc_id and text, one row a document; ``edits`` has doc_id, edit_id,
    start, stop (code points, the end exclusive) and new. Each edit is made to the
    document's text as it stands, independently of the others. A null text counts as
    empty, a null ``new`` as nothing; start and stop are moved into the text, null
    ones to its end. Edits of documents that are not there, or of a null doc_id, give
    no row. A document's table is made once for the edits that a task has of it.
    """
    path = path or vocabulary_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("of"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = edits.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("edit_id").cast("long").alias("edit_id"),
        F.col("start").cast("long").alias("start"),
        F.col("stop").cast("long").alias("stop"),
        F.coalesce(F.col("new").cast("string"), F.lit("")).alias("new"),
    )
    both = wanted.join(texts, F.col("doc_id") == F.col("of")).drop("of").sortWithinPartitions("doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("edit_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        base = None
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for row in batch.to_pylist():
                text = row["text"]
                if base is None or base.text != text:
                    base = TextTable(_encoder(path), text)
                a, b = (len(text) if x is None else min(max(x, 0), len(text)) for x in (row["start"], row["stop"]))
                ids = base.edited(a, max(a, b), row["new"]).ids()
                for column, value in zip(columns, (row["doc_id"], row["edit_id"], ids, len(ids))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return small_batches(both).mapInArrow(run, "doc_id long, edit_id long, ids array<int>, n_tokens long")
