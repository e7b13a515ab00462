"""Benchmark decontamination by Wu-Manber multi-pattern search.

The windows of the benchmark items (13 consecutive words; a shorter item is
one window) are the patterns. Documents and patterns are brought to one form:
A-Z in lower case, words joined by one space. The scan keeps a shift for the
hash of each block of bytes: how far the end of a search frame can move when
it sees that block. Most blocks occur in no pattern, and then the frame moves
by almost its whole length. A shift of zero selects a bucket of patterns by
the frame's last block; candidates are then compared byte for byte. Many
frames move in step over one buffer, so each step is a few array operations.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import quoted, utf8, with_columns

WINDOW = 13
#: Patterns of one scan: the benchmark texts of a block stay below this size;
#: a larger benchmark is scanned in several blocks, one pass for each.
BLOCK_BYTES = 32 << 20
TABLE_BITS = 20
LANE = 4096

_FORM = np.full(256, 32, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _FORM[_b] = _b
    elif 65 <= _b <= 90:
        _FORM[_b] = _b + 32


def canonical(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with the words of all texts, each followed by one space, and
    byte 1 after each text; and the place of these bytes."""
    raw = b"".join([(t or b"") + b"\0\0" for t in texts])
    ends = np.cumsum([len(t or b"") + 2 for t in texts]) - 1
    form = _FORM[np.frombuffer(raw, np.uint8)]
    word = form != 32
    keep = word.copy()
    keep[1:] |= word[:-1]
    form[ends] = 1
    keep[ends] = True
    out = form[keep]
    return out, np.flatnonzero(out == 1)


def words_of(text: bytes | None) -> list[bytes]:
    out, ends = canonical([text])
    return out[:ends[0]].tobytes().split()


class Frames:
    """Tables for patterns of about the same length and the scan with them."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = block = min(8, m)
        self.mask = np.uint64((1 << 8 * block) - 1)
        shift = np.full(1 << TABLE_BITS, m - block + 1, np.int32)
        buckets: dict[int, list[int]] = defaultdict(list)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + b"\0" * 8, np.uint8)
        at = np.arange(len(patterns), dtype=np.int64) * m
        for j in range(block, m + 1):
            h = self.hashes(heads, at + (j - block))
            np.minimum.at(shift, h, m - j)
        for k, h in enumerate(self.hashes(heads, at + (m - block)).tolist()):
            buckets[h].append(k)
        self.shift, self.buckets = shift, dict(buckets)

    def hashes(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Table place of the block that begins at each position."""
        view = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), (len(buf) - 7,), (1,))
        key = view[at] & self.mask
        key *= np.uint64(0x9E3779B97F4A7C15)
        return (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def scan(self, buf: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(place, pattern) of every occurrence that begins a word. The buffer
        has eight spare bytes behind ``size``."""
        m, block = self.m, self.block
        first = np.arange(0, size, LANE, dtype=np.int64)
        end, stop = first + m, np.minimum(first + LANE + m, size + 1)
        live = end < stop
        end, stop = end[live], stop[live]
        found = []
        while end.size:
            move = self.shift[self.hashes(buf, end - block)]
            stay = move == 0
            if stay.any():
                found.append(end[stay] - m)
                move[stay] = 1
            end = end + move
            live = end < stop
            if not live.all():
                end, stop = end[live], stop[live]
        if not found:
            return []
        at = np.concatenate(found)
        at = at[(at == 0) | (buf[np.maximum(at - 1, 0)] <= 32)]  # a word begins here
        text, out = buf.tobytes(), []
        for place, h in zip(at.tolist(), self.hashes(buf, at + (m - block)).tolist()):
            out += [(place, k) for k in self.buckets.get(h, ()) if text.startswith(self.patterns[k], place)]
        return out


class Matcher:
    """All windows of some benchmark items, in bands of similar length."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        owners: dict[bytes, set] = defaultdict(set)
        self.size: dict[bytes, int] = {}
        for item, text in items:
            w = words_of(text)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                p = b" ".join(w[i:i + n]) + b" "
                self.size[p] = n
                owners[p].update([item] if item is not None else [])
        self.owners = dict(owners)
        bands: dict[int, list[bytes]] = defaultdict(list)
        for p in sorted(owners):
            bands[min(len(p).bit_length(), 6)].append(p)
        self.frames = [Frames(p) for p in bands.values()]

    def search(self, texts: list[bytes | None]):
        """For each text: its number of words, [(first word, end)] spans that
        windows cover, and the set of items found."""
        out, ends = canonical(texts)
        buf = np.concatenate([out, np.zeros(8, np.uint8)])
        spaces = np.flatnonzero(out == 32)
        before = np.searchsorted(spaces, ends)  # words up to the end of each text
        first = np.concatenate([[0], before[:-1]]).astype(np.int64)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        hits = [(p, f.patterns[k]) for f in self.frames for p, k in f.scan(buf, len(out))]
        if hits:
            places = np.array([p for p, _ in hits])
            docs = np.searchsorted(ends, places).tolist()
            words = np.searchsorted(spaces, places).tolist()
            for (_, pattern), d, w in zip(hits, docs, words):
                i = w - int(first[d])
                spans[d].append((i, i + self.size[pattern]))
                items[d] |= self.owners[pattern]
        return (before - first).tolist(), spans, items


def covered(spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Spans with the overlaps merged, and the words in them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out, sum(b - a for a, b in out)


def item_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


FIELDS = ("n_words bigint, n_hit bigint, hit_spans array<array<int>>, hit_items array<string>, "
          "contaminated boolean")


def benchmark_blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of bounded size: read in order, one at a time."""
    rows = (bench.select(F.col(quoted(item_col)).cast("string").alias("i"), F.col(quoted(text_col)).alias("t"))
            .where(F.col("t").isNotNull()).distinct())
    block, size = [], 0
    for r in rows.toLocalIterator():
        t = r["t"].encode()
        block.append((r["i"], t))
        size += len(t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def mark_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW,
                      share: int = 20, keep: list[str] | None = None,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``hit_spans`` ([first word, end) pairs),
    ``hit_items`` (item ids as sorted strings) and ``contaminated`` (hits, and
    ``share`` times their number is at least ``n_words``).

    Documents never shuffle. The benchmark goes out as broadcasts of at most
    about ``block_bytes`` of text; each further block is one more pass that
    extends the spans of the last.

    Cases: null or empty text, or one without words, has no words, hits or
    items and is not contaminated. Repeated rows are judged alike, each on its
    own. Benchmark rows that are null or without words have no windows; a null
    item id counts for hits but is not listed. An empty benchmark marks
    nothing. ``keep`` names the input columns that stay; one with the name of
    an output column gives way to it.
    """
    sc = docs.sparkSession.sparkContext
    blocks = benchmark_blocks(bench, item_col, bench_text_col, block_bytes)
    out, n, nxt = docs, 0, next(blocks)
    while nxt is not None:
        items, nxt = nxt, next(blocks, None)
        names = list(keep) if keep is not None and nxt is None else list(out.columns)
        out = _one_pass(out, sc.broadcast(items), text_col, window, share, n > 0, names)
        n += 1
    return out


def _one_pass(df, items, text_col, window, share, again, keep):
    def start():
        matcher = Matcher(items.value, window)

        def judge(col, old_spans=None, old_items=None):
            n_words, spans, found = matcher.search(utf8(col))
            if again:
                for d, (s, i) in enumerate(zip(old_spans.to_pylist(), old_items.to_pylist())):
                    spans[d] += [tuple(x) for x in s]
                    found[d] |= set(i)
            merged = [covered(spans[d]) if d in spans else ([], 0) for d in range(len(n_words))]
            n_hit = [h for _, h in merged]
            return [n_words, n_hit, [[list(x) for x in s] for s, _ in merged],
                    [sorted(found.get(d, ())) for d in range(len(n_words))],
                    [h > 0 and share * h >= n for h, n in zip(n_hit, n_words)]]
        return judge
    uses = [text_col] + (["hit_spans", "hit_items"] if again else [])
    return with_columns(df, uses, FIELDS, start, keep)
