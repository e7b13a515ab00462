"""Line-first cleaning.

Each line is judged alone by punctuation, navigation and boilerplate rules.
Lines that fail are removed, and a document that loses too much of its text
with them is rejected. The lines are the unit of the decision; the document
sees only how much of it survived.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.common import utf8, with_columns

SPACE = b" \t\n\r\x0b\f"
SYMBOLS = b"#*$%&|<>"

#: Phrases of lines that frame a page and say nothing themselves.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here to", "cookie policy",
    "enable javascript", "forgot your password", "privacy policy", "read more at",
    "share this article", "share this page", "sign in to", "sign up for", "skip to content",
    "skip to main content", "subscribe to our", "terms and conditions", "terms of service",
    "terms of use", "this site uses cookies", "we use cookies",
)
#: Words that stand alone as separators between links.
SEPARATORS = ("|", ">", "»", "›", "·", "•", "/", "::", "-")
#: Characters that end or divide sentences.
SENTENCE = ".,;:!?…。、！？；：¿¡।؟"


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the two document rules.

    ``long_line``: words from which a line must hold a sentence mark.
    ``separator_pct``: separators in 100 words from which a line is
    navigation. ``symbol_pct``, ``shout_pct``: words that end in ``##``,
    ``**``, ``$$``, ``%%`` or ``&&`` (also before a mark), or in ``!!``, in
    100 from which a line fails. ``min_marked``: such words at least.
    ``short_line``: words up to which a line, or a sentence of a longer line,
    fails by a boilerplate phrase alone. ``lost_pct``: word characters in 100
    that a document may lose.
    """
    long_line: int = 60
    separator_pct: int = 15
    symbol_pct: int = 20
    shout_pct: int = 20
    min_marked: int = 3
    short_line: int = 20
    lost_pct: int = 50
    min_words: int = 50
    repeat_pct: int = 50


_SEP = frozenset(s.encode() for s in SEPARATORS)
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_MARK = re.compile("|".join(map(re.escape, SENTENCE)).encode())
_SENTENCES = re.compile(r".+?(?:[.!?]+(?=[ \t\n\r\x0b\f]|\Z)|…|。|！|？|।|؟|\Z)".encode(), re.S)
_SYMBOL_END = re.compile(rb"(?:##|\*\*|\$\$|%%|&&)(?=[ \t\n\r\x0b\f]|$)")
_SHOUT_END = re.compile(rb"!!(?=[ \t\n\r\x0b\f]|$)")


def is_boilerplate(line: bytes, rules: Rules = Rules()) -> bool:
    """Whether boilerplate phrases frame a line: it holds one and is short, or
    they make up most of it; a longer line, whether such sentences do. A text
    that only mentions a phrase is none."""
    low = line.lower()
    if not _BOILER.search(low):
        return False
    if len(low.split()) <= rules.short_line:
        return True
    framed = 0
    for sentence in _SENTENCES.findall(low):
        size = len(sentence.translate(None, SPACE))
        phrases = sum(len(x.translate(None, SPACE)) for x in _BOILER.findall(sentence))
        if phrases and (len(sentence.split()) <= rules.short_line or 2 * phrases > size):
            framed += size
    return 2 * framed > len(low.translate(None, SPACE))


def line_fault(line: bytes, rules: Rules = Rules()) -> str:
    """The rule that a line fails: ``punctuation``, ``navigation``,
    ``boilerplate``, or empty. A line without words fails none."""
    words = line.split()
    n = len(words)
    if not n:
        return ""
    for pattern, pct in ((_SYMBOL_END, rules.symbol_pct), (_SHOUT_END, rules.shout_pct)):
        marked = len(pattern.findall(line))
        if marked >= rules.min_marked and 100 * marked >= pct * n:
            return "punctuation"
    if n >= rules.long_line and not _MARK.search(line):
        return "punctuation"
    separators = sum(map(_SEP.__contains__, words))
    if separators >= rules.min_marked and 100 * separators >= rules.separator_pct * n:
        return "navigation"
    return "boilerplate" if is_boilerplate(line, rules) else ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter([ids.setdefault(x, len(ids)) for x in words], np.int64, len(words))
    if len(ids) == len(words):
        return 0
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    _, place, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k:len(words) - 2 + k] |= again
    return int(hit.sum())


def judge(text: bytes | None, rules: Rules = Rules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lost_chars, kept, clean text) of one text."""
    text = text or b""
    words = text.split()
    n_words = len(words)
    letters = len(text.translate(None, SPACE).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    with_word = [x for x in lines if x.strip()]
    repeats = repeated_words(words)
    failed = n_words < rules.min_words or 100 * repeats > rules.repeat_pct * n_words
    faults: dict[bytes, str] = {x: line_fault(x, rules) for x in dict.fromkeys(lines)}
    good = [x for x in lines if not faults[x]]
    clean = b"\n".join(good)
    lost = letters - len(clean.translate(None, SPACE).decode())
    kept = not failed and 100 * lost <= rules.lost_pct * letters
    return (n_words, letters, symbols, len(with_word) - len(set(with_word)), repeats, failed, lost,
            kept, clean.decode())


FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, lost_chars bigint, kept boolean")


def clean_lines(docs: DataFrame, text_col: str = "text", rules: Rules = Rules(),
                keep: list[str] | None = None, clean_col: str | None = "clean_text") -> DataFrame:
    """Add the base counts, ``base_failed``, ``lost_chars`` (word characters in
    removed lines), ``kept`` and the text of the surviving lines.

    One pass without a shuffle; a document is judged from its own text only,
    so hot sources, copies and repeated rows change nothing. Cases: a null or
    empty text, or one of white space, has no words, so ``base_failed`` is true
    and ``kept`` false; its clean text is empty (white space stays). Lines
    without words are never removed. ``clean_col=None`` leaves the clean text
    out. An input column named like an output column gives way to it.
    """
    fields = FIELDS + (f", {clean_col} string" if clean_col else "")

    def start():
        def f(col):
            rows = [judge(t, rules) for t in utf8(col)]
            n = 8 + bool(clean_col)
            return [list(x) for x in list(zip(*rows))[:n]] if rows else [[]] * n
        return f
    return with_columns(docs, [text_col], fields, start, keep)
