"""Quality rules, line first: clean line by line, then judge what a document has lost."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import per_text, small_batches

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

# Phrases of boilerplate lines, matched in lower case.
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|copyright (?:\(c\)|©|\d)|©\s*\d{4}"
    r"|subscribe to our newsletter|sign up for our|click here to|enable javascript|powered by|alle rechte vorbehalten|tous droits réservés"
    r"|todos los derechos reservados|licensed under|spdx-license-identifier"
)
#: Separators of navigation lines.
_MENU = re.compile(r" [|»›·>] ")
#: A line of so many separated parts of at most MENU_WORDS words each is navigation.
MENU_PARTS, MENU_WORDS = 3, 4
#: Lines of at least LONG_LINE words need sentence punctuation somewhere.
LONG_LINE = 30
_STOP = re.compile(r"[.!?;:…。！？\"”»)]")
#: A line with a larger share of symbols than this fails.
SYMBOL_SHARE = 0.2
#: So do three words or more with more exclamation marks a word than this.
SHOUTED = 0.5
#: A document fails that loses more than this share of its words' characters to failing lines.
MOST_LOST = 0.5


def words_of(text: str) -> list[str]:
    """Words of a text: runs of characters other than space and U+0009..U+000D."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in _SPACE.split(text) if w]


def repeated_words(words: list[str], width: int = 5) -> int:
    """Number of words that stand in a ``width``-word window found twice or more, first included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = upto = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, upto)
            upto = i + width
    return covered


def line_fails(line: str) -> str | None:
    """The rule by which a line with a word fails: boilerplate, navigation, punctuation; None if it stays."""
    if BOILERPLATE.search(line.lower()):
        return "boilerplate"
    parts = _MENU.split(line)
    if len(parts) >= MENU_PARTS and all(len(p.split()) <= MENU_WORDS for p in parts):
        return "navigation"
    if len(_SYMBOLS.findall(line)) > SYMBOL_SHARE * len(line):
        return "punctuation"
    n_words = len(line.split())
    if line.count("!") > SHOUTED * n_words and n_words >= 3:
        return "punctuation"
    if n_words >= LONG_LINE and not _STOP.search(line):
        return "punctuation"
    return None


def clean_lines(text: str) -> tuple[str, Counter]:
    """(text without its failing lines, characters in words lost by rule)."""
    stay, lost = [], Counter()
    for line in text.split("\n"):
        why = line_fails(line) if line and not line.isspace() else None
        if why is None:
            stay.append(line)
        else:
            lost[why] += sum(map(len, words_of(line)))
    return "\n".join(stay), lost


def judge_text(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars)."""
    text = text or ""
    words = words_of(text)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if words_of(x)] if "\n" in text else []
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    lost = sum(clean_lines(text)[1].values())
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats, failed, not failed and lost <= MOST_LOST * chars, lost


#: What ``judge_text`` gives.
COLUMNS = {
    **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), pa.int64()),
    **dict.fromkeys(("base_failed", "kept"), pa.bool_()),
    "lost_chars": pa.int64(),
}


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, whether the base rules fail it, and the verdict.

    A null or empty text has no words and so fails. Repeated rows come back repeated,
    a null doc_id stays null, an empty table gives no rows. Only doc_id and text are
    read, so columns named like the results don't clash; a document's whole text is
    judged in one task.
    """
    return per_text(docs, COLUMNS, lambda: lambda texts: list(zip(*map(judge_text, texts))))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their failing lines removed; other columns as they are.

    Null and empty texts have no words and go. Repeated rows are judged alike, ids are
    not looked at, an empty table gives no rows, and other columns pass whatever their names.
    """

    @F.pandas_udf("string")
    def cleaned(s: pd.Series) -> pd.Series:
        return s.map(lambda t: clean_lines(t)[0] if judge_text(t)[6] else None, na_action="ignore")

    return small_batches(docs).withColumn("text", cleaned(F.col("text").cast("string"))).where("text IS NOT NULL")
