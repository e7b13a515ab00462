"""Exact token counts at every prefix of a text, by dynamic programming.

The model is a sentencepiece BPE with byte fallback. If the encoding of a text
ends in the piece p, then without p it is the encoding of the shorter prefix.
So the count of a prefix is the count of a shorter prefix plus one, and only
the last piece is wanted: of the pieces that end there, the one that stays
apart from the last piece of the shorter prefix. Whether two pieces stay apart
is asked of the library once and kept.

No piece holds a space mark behind another character, so a text falls into
segments (space marks, then other characters) that are encoded on their own.
The steps of a segment's counts are kept in a bounded table; the counts of a
text are the running sum over its segments, and any question about truncation
or budgets is answered from them without encoding again.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quire.llm.common import with_columns

MARK = "▁"
LIMIT = 4096


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounts:
    def __init__(self, model: str, segments: int = 400_000, pairs: int = 400_000, states: int = 300_000):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_unknown(i) or self.sp.is_control(i)
                                             or self.sp.is_unused(i) or self.sp.is_byte(i))]
        self.pieces = {p: p for p in map(self.sp.id_to_piece, plain)}
        # lengths, longest first, of the pieces that end in some three characters
        ends: dict[str, set[int]] = {}
        for p in self.pieces:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {e: tuple(sorted(n, reverse=True)) + (2, 1) for e, n in ends.items()}
        probe = self.sp.encode("a  b ", out_type=str)
        if (any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.pieces) or MARK not in self.pieces
                or "".join(probe) != f"{MARK}a{MARK}{MARK}b{MARK}" or not self.sp.is_byte(self.sp.piece_to_id("<0x0A>"))):
            raise ValueError("the model must put a space mark first, keep all spaces, fall back to bytes "
                             "and hold no piece across a space")
        self.apart: dict[tuple[str, str], bool] = {}
        self.pairs = pairs
        self.states: dict[str, tuple[list, list]] = {}
        self.most_states = states

        class Segments(dict):
            def __missing__(me, word):
                s = self.steps(MARK + word)
                if len(me) < segments and len(word) < 64:
                    me[word] = s
                return s

        self.segments = Segments()
        self.irregular = re.compile(f"{MARK}{MARK}|\\A{MARK}|{MARK}\\Z")
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def stay_apart(self, last: str, piece: str) -> bool:
        """Whether ``piece`` behind ``last`` (empty: none) stays a piece."""
        # behind a line feed, which no piece holds, nothing precedes them
        got = self.sp.encode("\n" + (last + piece).replace(MARK, " "), out_type=str)[2:]
        if len(self.apart) >= self.pairs:
            self.apart.clear()
        self.apart[last, piece] = fits = got == ([last, piece] if last else [piece])
        return fits

    def steps(self, s: str) -> bytes:
        """The change of the count at each code point of one segment. The
        counts of prefixes that other segments share are taken from theirs."""
        pieces, lengths, known, states = self.pieces, self.lengths, self.apart, self.states
        counts, lasts, size = [0], [""], len(s)
        for i in range(min(size, 40), 3, -1):
            got = states.get(s[:i])
            if got:
                counts, lasts = got[0][:i + 1], got[1][:i + 1]
                break
        for i in range(len(counts), size + 1):
            for n in lengths.get(s[i - 3:i] if i > 2 else "", (2, 1)):
                if n <= i:
                    p = pieces.get(s[i - n:i])
                    if p:
                        last = lasts[i - n]
                        fits = known.get((last, p))
                        if fits is None:
                            fits = self.stay_apart(last, p)
                        if fits:
                            counts.append(counts[i - n] + 1)
                            lasts.append(p)
                            break
            else:  # a character of no piece: its bytes, which join nothing
                counts.append(counts[i - 1] + len(s[i - 1].encode()))
                lasts.append("")
        if size < 40 and len(states) < self.most_states:
            both = counts, lasts
            for i in range(size, 3, -2):
                states.setdefault(s[:i], both)
        return array("b", [y - x for x, y in zip(counts, counts[1:])]).tobytes()

    def text_steps(self, text: str) -> bytes:
        """The change of the count at each code point of a whole text."""
        if not text:
            return b""
        t = text.replace(" ", MARK)
        if self.irregular.search(t):
            parts = self.split.findall(t)
            # the text's first segment gets the mark that the model puts first
            first, rest = parts[0], [p[1:] for p in parts[1:]]
        else:
            first, *rest = t.split(MARK)
        head = np.frombuffer(self.segments[first], np.int8).copy()
        head[1] += head[0]  # the mark put first is no character of the text
        return head[1:].tobytes() + b"".join(map(self.segments.__getitem__, rest))


def prefix_counts(steps: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def longest_prefix(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(steps) <= budget)[-1])


def count_tokens(docs: DataFrame, text_col: str = "text", limit: int = LIMIT, model: str | None = None,
                 keep: list[str] | None = None, store: bool = False) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens``, ``fit_chars`` (code points of the
    longest prefix within ``limit`` tokens) and ``over_limit``; with ``store``
    also ``prefix_steps``, one signed byte per code point, from which
    ``prefix_counts`` and ``longest_prefix`` answer later questions.

    One pass without a shuffle. Cases: null and empty texts have no tokens and
    are within any limit; texts without spaces, of any length, take time in
    proportion to their length; special strings inside a text are ordinary
    text, as the library takes them; repeated rows count alike. An input
    column named like an output column gives way to it.
    """
    path = model or default_model()
    fields = "n_bytes bigint, n_tokens bigint, fit_chars bigint, over_limit boolean"

    def start():
        table = PrefixCounts(path)

        def f(col):
            n_bytes, n_tokens, fit, kept = [], [], [], []
            for text in col.to_pylist():
                steps = table.text_steps(text or "")
                n = int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(n)
                fit.append(len(steps) if n <= limit else longest_prefix(steps, limit))
                kept.append(steps if store else None)
            out = [n_bytes, n_tokens, fit, [n > limit for n in n_tokens]]
            return out + ([pa.array(kept, pa.binary())] if store else [])
        return f
    return with_columns(docs, [text_col], fields + (", prefix_steps binary" if store else ""), start, keep)
