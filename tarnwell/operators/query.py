"""Planning of one query on the driver: tokens, anchors, shape, limits."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

from tarnwell.functions.text import FRAGMENT

_CUT = regex.compile(r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
_OTHER = regex.compile(r"[^\p{L}\p{Nd}]+")
_PATH = regex.compile(r"\.(?:go|ts|tsx)$", regex.I)
_STRONG = regex.compile(r"[_.\-]|\p{Nd}|(?<=.)\p{Lu}")


class QueryError(ValueError):
    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Anchor:
    raw: str
    normalized: str
    high: bool


@dataclass
class Query:
    text: str
    shape: str = "descriptive"
    terms: list[str] = field(default_factory=list)
    identifier_tokens: list[str] = field(default_factory=list)
    text_tokens: list[str] = field(default_factory=list)
    symbols: list[Anchor] = field(default_factory=list)
    paths: list[Anchor] = field(default_factory=list)
    exact_symbol: str = ""


def normalize(name: str) -> str:
    """The words of an identifier; the driver's twin of ``normalize_identifier``."""
    return _OTHER.sub(" ", _CUT.sub(" ", name)).strip().lower()


def _distinct(anchors: list[Anchor]) -> list[Anchor]:
    best: dict[tuple[str, str], Anchor] = {}
    for a in anchors:
        known = best.get((a.raw, a.normalized))
        best[a.raw, a.normalized] = Anchor(a.raw, a.normalized, a.high or (known is not None and known.high))
    return list(best.values())


def plan_query(text: str, max_bytes: int = 8192, max_tokens: int = 64, max_token_runes: int = 128) -> Query:
    """Tokens and anchors of a query text. Identifier tokens come first; each term once."""
    try:
        if len(text.encode("utf-8")) > max_bytes:
            raise QueryError("invalid_query", "too many bytes")
    except UnicodeEncodeError:
        raise QueryError("invalid_query", "not valid UTF-8") from None
    q = Query(text)
    found = regex.findall(FRAGMENT, text)
    for raw in found:
        words = normalize(raw)
        is_path = "/" in raw or bool(_PATH.search(raw))
        high = is_path or bool(_STRONG.search(raw))
        weak = not high and len(raw) > 1 and raw[0].isupper()
        if not (high or weak):
            q.text_tokens += words.split()
            continue
        q.identifier_tokens += words.split()
        (q.paths if is_path else q.symbols).append(Anchor(raw, words, high))
    every = q.identifier_tokens + q.text_tokens
    if not every:
        raise QueryError("empty_query", "no searchable tokens")
    if len(every) > max_tokens:
        raise QueryError("invalid_query", "too many tokens")
    if any(len(t) > max_token_runes for t in every):
        raise QueryError("invalid_query", "a token is too long")
    if len(found) == 1 and not q.paths:
        q.exact_symbol = normalize(found[0])
        if not q.symbols:
            q.symbols.append(Anchor(found[0], q.exact_symbol, True))
    q.symbols, q.paths, q.terms = _distinct(q.symbols), _distinct(q.paths), list(dict.fromkeys(every))
    if q.paths or any(a.high for a in q.symbols):
        q.shape = "mixed" if q.text_tokens and len(found) > 1 else "anchor"
    return q


def effective_shape(q: Query, symbol_hits: int, path_hits: int) -> str:
    """The shape once the index has shown which weak anchors name something."""
    if q.shape != "descriptive" or not symbol_hits + path_hits:
        return q.shape
    return "mixed" if q.text_tokens or len(q.terms) > 1 else "anchor"
