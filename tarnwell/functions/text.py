"""Text functions of the retrieval engine, as column expressions.

Each has a twin in SQL text (``*_sql``) for checking against another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Precomposed Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

#: A query fragment: a letter or digit, then letters, digits and the separators of names and paths.
FRAGMENT = r"[\p{L}\p{Nd}][\p{L}\p{Nd}_./\-]*"


def normalize_identifier(name: Column) -> Column:
    """Words of an identifier, lowered, a space between: split at case changes and all else than letters and digits."""
    cut = F.regexp_replace(name, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.lower(F.trim(F.regexp_replace(cut, r"[^\p{L}\p{Nd}]+", " ")))


def normalize_identifier_sql(name: str) -> str:
    cut = rf"regexp_replace(regexp_replace({name}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"lower(trim(regexp_replace({cut}, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')))"


def index_tokens(text: Column) -> Column:
    """Tokens of indexed text: runs of letters and numbers, lowered, accents dropped."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def index_tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def fragments(text: Column) -> Column:
    """Fragments of a query text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({FRAGMENT})"), F.lit(1))


def is_path(fragment: Column) -> Column:
    return F.contains(fragment, F.lit("/")) | F.lower(fragment).rlike(r"\.(go|ts|tsx)$")


def confidence(fragment: Column) -> Column:
    """'high' for identifier-like fragments, 'weak' for a leading capital only, else 'text'."""
    strong = is_path(fragment) | fragment.rlike(r"[_.\-]") | fragment.rlike(r"\p{Nd}") | fragment.rlike(r"^.\P{Lu}*\p{Lu}")
    weak = (F.length(fragment) > 1) & fragment.rlike(r"^\p{Lu}")
    return F.when(strong, "high").when(weak, "weak").otherwise("text")


def confidence_sql(f: str) -> str:
    return (
        rf"CASE WHEN contains({f}, '/') OR regexp_matches(lower({f}), '\.(go|ts|tsx)$') OR regexp_matches({f}, '[_.\-]') OR regexp_matches({f}, '\p{{Nd}}')"
        rf" OR regexp_matches({f}, '^.\P{{Lu}}*\p{{Lu}}') THEN 'high' WHEN length({f}) > 1 AND regexp_matches({f}, '^\p{{Lu}}') THEN 'weak' ELSE 'text' END"
    )


def safe_token(token: Column) -> Column:
    """Whether a token may be searched for: letters and digits only."""
    return F.coalesce(token.rlike(r"^[\p{L}\p{Nd}]+$"), F.lit(False))


def escape_like(text: Column, mark: str = "!") -> Column:
    """A literal text as a LIKE pattern with this escape character."""
    out = F.replace(text, F.lit(mark), F.lit(mark * 2))
    for c in "%_":
        out = F.replace(out, F.lit(c), F.lit(mark + c))
    return out


def glob_to_regex(glob: str) -> str:
    """A path glob as an anchored regular expression; ``**`` matches whole segments, also none."""
    parts = glob.strip("/").split("/")
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part)
        out.append(body if last else body + "/")
    return "^" + "".join(out) + "$"


def admitted(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is included by one of the globs and excluded by none."""
    hit = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end, exclusive, of a text's UTF-8, as text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def line_of_byte(text: Column, offset: Column) -> Column:
    """1-based number of the line that holds the byte at ``offset``."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset), "ISO-8859-1")
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def domain_sha256(domain: str, payload: Column) -> Column:
    """Hex SHA-256 of a domain name, a zero byte and a payload of bytes."""
    return F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lit("00")), payload), 256)
