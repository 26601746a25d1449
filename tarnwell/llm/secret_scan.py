"""Secret scan: fixed patterns plus a token-efficiency test.

The test takes every run of key characters of a whole text that is long enough. A
byte-pair vocabulary was merged from ordinary text, so it spells words in few
tokens and random strings in many: a run with few characters a token is random.
Known digests (hex of a digest's length, Base64 after the digest's name) and UUIDs
are cut out of a run first, whatever stands around them, and what is left is tested;
plain numbers and runs of one kind of letter are left out too.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import held, per_text, small_batches

#: Fixed patterns, in the order in which kinds are listed: (kind, pattern, group, least characters).
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "random")

#: A run is tested from so many characters on, and is random below so many characters a token.
LEAST_RUN = 20
RATIO = 2.2
VOCABULARY = "byte_bpe_50k.tiktoken"

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
#: What stands between the separators of a run.
_PIECE = re.compile(r"[A-Za-z0-9+]{%d,}" % LEAST_RUN)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
# Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: What is known within a run: hex digests and UUIDs that no letter or digit touches, and the
#: Base64 of a digest after its name.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|"
    + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_LENGTHS)
    + r")(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?i:md5|sha-?(?:1|224|256|384|512))[=_/-](?:"
    + "|".join(f"[A-Za-z0-9+/]{{{-(-n * 2 // 3)}}}(?![A-Za-z0-9+/])={{0,2}}" for n in DIGEST_LENGTHS)
    + ")"
)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoding(path: str):
    return held(("secret_scan", path), lambda: _load(path))


def _load(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_string(run: str) -> bool:
    """Whether a run is a digest, an identifier or has only one kind of character."""
    if _DIGEST.match(run) and len(run) in DIGEST_LENGTHS:
        return True
    if _UUID.match(run):
        return True
    kinds = (any("a" <= c <= "z" for c in run)) + (any("A" <= c <= "Z" for c in run)) + (any("0" <= c <= "9" for c in run))
    return kinds < 2


def random_runs(text: str, path: str, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Spans of the runs that the vocabulary spells inefficiently.

    A run that passes as a whole is looked at again by the pieces between its
    separators, since words joined to a random string make up for its tokens.
    """

    def is_random(run: str) -> bool:
        return len(run) >= LEAST_RUN and not known_string(run) and len(run) < ratio * len(_encoding(path).encode_ordinary(run))

    found = []
    for m in _RUN.finditer(text):
        for begin, end in _unknown(m.group()):
            # Separators and padding at the ends belong to the text around.
            run = m.group()[begin:end].strip("=/_-+")
            start = m.start() + m.group().index(run, begin)
            if len(run) < LEAST_RUN or known_string(run):
                continue
            if is_random(run):
                found.append((start, start + len(run)))
            else:
                found += [(start + x.start(), start + x.end()) for x in _PIECE.finditer(run) if x.end() - x.start() < len(run) and is_random(x.group())]
    return found


def _unknown(run: str) -> list[tuple[int, int]]:
    """The stretches of a run around the known strings in it."""
    out, at = [], 0
    for m in _KNOWN.finditer(run):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(run))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in order."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "assign" and ":" not in text and "=" not in text:
            continue
        if kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str | None, path: str) -> tuple[list, list]:
    """(base spans, all spans) as (start, kind's number, end), ordered by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + [(s, len(PATTERNS), e) for s, e in random_runs(text, path)])


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Offsets are code points, ends exclusive. A null or empty text has no span. Every
    row gives a row, repeated ones too; a null doc_id stays null; an empty table
    gives none. Only doc_id and text are read, so columns named like the results
    don't clash.
    """
    path = path or vocabulary_path()
    kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_random": pa.int64()}

    def row(text):
        base, spans = scan_text(text, path)
        n = [sum(k == x for _, k, _ in spans) for x in range(len(KINDS))]
        return n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3]

    return per_text(docs, kinds, lambda: lambda texts: list(zip(*map(row, texts))))


def redact(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The documents with each secret replaced by ``[kind]``; overlapping spans become one.

    Texts without a secret, null and empty texts and all other columns, whatever their
    names, stay as they are. Every row stays, repeated ones too; an empty table stays empty.
    """
    path = path or vocabulary_path()

    def clean(t: str | None) -> str | None:
        spans = scan_text(t, path)[1]
        if not spans:
            return t
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [t[at:s], f"[{KINDS[k]}]"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def cleaned(s: pd.Series) -> pd.Series:
        return s.map(clean, na_action="ignore")

    return small_batches(docs).withColumn(text, cleaned(F.col(text).cast("string")))
