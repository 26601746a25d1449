"""BPE encoding and decoding by a contiguous rank array, for the word vocabulary.

A word starts as one part per byte, with the word-end mark on the last. Next to the
parts stands the rank of the merge of each part with its right neighbour. Again and
again the least rank is looked for, leftmost first, its right part is deleted, and
the ranks of the two neighbouring pairs are renewed. For a short word this scan of
a few adjacent integers is cheaper than any ordered structure; a long one uses a
heap over linked parts, which merges in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import string
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tarnwell.llm.common import Store, held, per_text

VOCABULARY = "word_bpe_49k.json"
#: Words of more parts than this go to the heap.
SHORT = 48
#: Chunks that an encoder keeps in each of two generations.
CACHE = 200_000
_NO_RANK = 1 << 30
# The white space of Unicode.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = regex.compile(f"[{_WHITE}]+")
#: Letters below this have long been letters in every Unicode table.
_LATIN_END = "\u0250"
#: Python splits at these too, the vocabulary doesn't.
_CONTROLS = regex.compile(r"[\x1c-\x1f]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a vocabulary file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] * self.size + vocab[b]] = (rank, vocab[a + b])
        # The file's own pattern says what a word is.
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", _WHITE))
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.chunks = Store(self._chunk, CACHE)
        self.tails = Store(self._word, 10_000)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        merges, size = self.merges, self.size
        none = (_NO_RANK, 0)
        ranks = [merges.get(a * size + b, none)[0] for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = merges[parts[i] * size + parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] * size + parts[i], none)[0]
            if i < len(ranks):
                ranks[i] = merges.get(parts[i] * size + parts[i + 1], none)[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        merges, size = self.merges, self.size
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        gone = [False] * len(parts)
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (m := merges.get(parts[i] * size + parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i] = merges[a * size + b][1]
            gone[j], after[i] = True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merges.get(parts[x] * size + parts[y])):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y]))
        return [p for p, dead in zip(parts, gone) if not dead]

    def _word(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space. Letters are one word, and so is the punctuation after them."""
        body = chunk.rstrip(string.punctuation)
        if not body.isalpha() or not body.isascii() and max(body) >= _LATIN_END:
            return b"".join(map(self._word, self.words.findall(chunk)))
        if len(body) == len(chunk):
            return self._word(chunk)
        return self.chunks[body] + self.tails[chunk[len(body) :]]

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # Letters are lowered one by one, whatever stands around a sigma.
            text = text.replace("Σ", "σ")
        text = text.lower()
        chunks = [c for c in _SPACE.split(text) if c] if _CONTROLS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        ids, at = [], 0
        for m in [*self.marks.finditer(text), None]:
            ids.append(self._plain(text[at : m.start() if m else len(text)]))
            if m:
                ids.append(struct.pack("<I", self.special[m.group()]))
                at = m.end()
        return b"".join(ids)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens with a space between; ids that the vocabulary lacks are left out."""
        return " ".join([t for i in ids if 0 <= i < self.size and (t := self.tokens[i])])


def _coder(path: str) -> WordBpe:
    return held(("bpe", path), lambda: WordBpe(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array of int), n_tokens.

    Null and empty texts have no token. Repeated rows come back repeated, a null
    doc_id stays null, an empty table gives no rows. Only doc_id and text are read,
    so columns named like the results don't clash.
    """
    path = path or vocabulary_path()

    def start():
        coder = _coder(path)

        def rows(texts):
            blobs = list(map(coder.encode_bytes, texts))
            n = np.array([len(b) // 4 for b in blobs], np.int64)
            values = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(blobs))])
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), values), n]

        return rows

    return per_text(docs, {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}, start)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no token. Repeated rows come back repeated, a null
    doc_id stays null, an empty table gives no rows. Only doc_id and text are read,
    so columns named like the results don't clash.
    """
    path = path or vocabulary_path()

    def start():
        coder = _coder(path)

        def rows(texts):
            out: tuple[list, list, list] = ([], [], [])
            for ids in map(coder.encode_bytes, texts):
                out[0].append(len(ids) // 4)
                out[1].append(hashlib.sha256(ids).hexdigest())
                out[2].append(hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            return list(out)

        return rows

    return per_text(docs, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, start)
