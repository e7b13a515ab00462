"""Maximal repetitions (runs) of words, found by Baier grouping.

The first phase of Baier's suffix sorter puts the positions of a sequence into
groups by growing prefixes; when a group's turn comes, its common prefix is the
longest Lyndon word that starts at each of its positions. Done under the order
of the letters and under the reverse order, this gives both Lyndon arrays, and
every run has a root that one of them holds. Each root is extended to both
sides by longest common extensions, answered with prefix hashes and binary
search; a root that reaches over two periods is a run, and each run found is
compared word by word with itself one period on.

A run of at least 12 words and two periods repeats each of its 5-word shingles
a period before or after, so only stretches covered by shingles that occur
twice in their text are searched; stretches of many texts are searched together.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import utf8, with_columns

#: Words of the shortest run, and words of the shingles that such a run repeats.
#: Shingles fit if each period q has q >= SHINGLE or SHORTEST >= 2 * q + SHINGLE - 1.
SHORTEST, SHINGLE = 12, 5
#: Fixed value: an odd factor of prefix hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * FACTOR
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lyndon_lengths(s: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each position of ``s``, numbers
    from 0. Zeros separate sequences; at them the length is 0.

    Groups are taken from the highest down. For each position of a group, the
    nearest one before it in a lower group is found by pointers over positions
    already taken. Its prefix grows by the group's, as often as the group points
    at it, and it moves to a new group right above its own, those with more
    pointers higher.
    """
    order = np.argsort(s, kind="stable")
    order = order[np.searchsorted(s[order], 1):]
    out = [0] * len(s)
    members = [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(s[order])) + 1)] if len(order) else []
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group, pointer = [-1] * len(s), [-2] * len(s)  # pointer -2: not taken yet; group -1: a separator
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    g = len(members) - 1
    while g >= 0:
        size, moves = length[g], defaultdict(list)
        last, times = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue  # moved up
            out[i] = size
            j = i - 1
            while j >= 0 and pointer[j] != -2:
                j = pointer[j]
            pointer[i] = j
            if j == last:
                times += 1
            else:
                if times and last >= 0 and group[last] >= 0:
                    moves[times].append(last)
                last, times = j, 1
        if times and last >= 0 and group[last] >= 0:
            moves[times].append(last)
        for k in sorted(moves, reverse=True):
            made: dict[int, int] = {}
            for p in moves[k]:
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    length.append(length[old] + k * size)
                    below.append(old)
                    above.append(above[old])
                    below[above[old]] = new  # group g at least lies above
                    above[old] = new
                members[new].append(p)
                group[p] = new
        g = below[g]
    return np.array(out, np.int64)


class Extensions:
    """Longest common extensions of two positions, by prefix hashes."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        power = np.full(self.n + 1, FACTOR, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.power = power[::-1]  # FACTOR to what is left of the sequence
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed(s) * power[:-1], out=self.prefix[1:])

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.prefix[b] - self.prefix[a]) * self.power[a]

    def _longest(self, limit: np.ndarray, equal) -> np.ndarray:
        out = np.zeros(len(limit), np.int64)
        step = 1 << int(limit.max(initial=0)).bit_length()
        while step:
            more = out + step
            at = np.flatnonzero(more <= limit)
            out[at[equal(at, more[at])]] += step
            step >>= 1
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequence goes on alike from a and from the later b."""
        return self._longest(self.n - b, lambda at, m: self._hash(a[at], a[at] + m) == self._hash(b[at], b[at] + m))

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far it is alike before a and before the later b."""
        return self._longest(a, lambda at, m: self._hash(a[at] - m, a[at]) == self._hash(b[at] - m, b[at]))


def _by_words(s: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Begin and end of the stretch around [i, i + p) that keeps period p."""
    a, b = i, i + p
    while b < len(s) and s[b] == s[b - p]:
        b += 1
    while a > 0 and s[a - 1] == s[a - 1 + p]:
        a -= 1
    return a, b


def runs_of(s: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs of ``s``
    with at least ``shortest`` places and two periods; zeros in ``s`` separate
    sequences and lie in no run."""
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    extend, found = Extensions(s), []
    for order in (s, np.where(s > 0, s.max() + 1 - s, 0)):
        size = lyndon_lengths(order)
        i = np.flatnonzero(size)
        p = size[i]
        hit = (s[i] == s[i + p]) | (s[i - 1] == s[i + p - 1])
        i, p = i[hit], p[hit]
        a, b = i - extend.behind(i, i + p), i + p + extend.ahead(i, i + p)
        whole = b - a >= np.maximum(2 * p, shortest)
        found.append(np.stack([a, b - a, p, i], 1)[whole])
    rows = np.concatenate(found)
    _, first = np.unique(rows[:, [0, 2, 1]], axis=0, return_index=True)
    good = []
    for a, n, p, i in rows[first].tolist():
        if not (s[a:a + n - p] == s[a + p:a + n]).all():  # two hashes agreed by chance
            a, b = _by_words(s, i, p)
            n = b - a
            if n < max(2 * p, shortest):
                continue
        good.append((a - 1, n, p))
    good = sorted(set(good), key=lambda r: (r[0], r[2]))
    return np.array(good, np.int64).reshape(-1, 3)


def text_runs(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text; the place of its first word among all of them;
    rows (place of the start, length, period) of all runs, in this order."""
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    words = [t.split() if t else [] for t in texts]
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=begin[1:])
    ids = np.fromiter((number[x] for w in words for x in w), np.int64, begin[-1])
    text = np.repeat(np.arange(len(words)), np.diff(begin))
    n = len(ids) - SHINGLE + 1
    none = np.zeros((0, 3), np.int64)
    if n <= 0:
        return words, begin, none
    spread, h = mixed(ids), mixed(text[:n])
    for k in range(SHINGLE):
        h = h * FACTOR + spread[k:k + n]
    at = np.flatnonzero(text[:n] == text[SHINGLE - 1:])
    at = at[np.argsort(h[at], kind="stable")]
    same = np.flatnonzero(h[at[1:]] == h[at[:-1]])
    twice = np.zeros(n, bool)
    twice[at[same]] = twice[at[same + 1]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[SHINGLE:SHINGLE + n] -= twice
    place = np.flatnonzero(np.cumsum(edge)[:-1])
    if not len(place):
        return words, begin, none
    cut = np.flatnonzero((np.diff(place) > 1) | (np.diff(text[place]) > 0)) + 1
    size = np.diff(np.concatenate([[0], cut, [len(place)]]))
    stretch = np.repeat(np.arange(len(size)), size)
    long = size[stretch] >= SHORTEST
    place, stretch = place[long], stretch[long]
    if not len(place):
        return words, begin, none
    gap = np.flatnonzero(np.diff(stretch)) + 1
    s, where = np.insert(ids[place], gap, 0), np.insert(place, gap, -1)
    found = runs_of(s)
    found[:, 0] = where[found[:, 0]]
    return words, begin, found


def find_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period, in words, by
    start and period) and ``collapsed``: the text's words without those that a
    run repeats after its first period, joined by one space.

    One pass without a shuffle. Words are what white space of ASCII separates.
    Cases: a null, empty or white text has no words, no runs and the empty
    collapsed text; texts of any length are read whole; each of repeated rows
    is judged alike; an empty table gives no rows; an input column named like
    an output column, in any case, gives way to it, other columns stay.
    """
    def start():
        def f(col):
            words, begin, found = text_runs(utf8(col))
            owner = np.searchsorted(begin, found[:, 0], side="right") - 1
            drop = np.zeros(begin[-1] + 1, np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(drop) == 0
            collapsed = [b" ".join(w) for w in words]
            for d in np.unique(owner).tolist():
                mask = kept[begin[d]:begin[d + 1]].tolist()
                collapsed[d] = b" ".join([w for w, k in zip(words[d], mask) if k])
            found[:, 0] -= begin[owner]
            at = np.searchsorted(owner, np.arange(len(words) + 1))
            rows = pa.StructArray.from_arrays([pa.array(found[:, k].copy()) for k in range(3)], ["start", "length", "period"])
            return [pa.array(np.diff(begin)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows),
                    pa.array(collapsed, pa.binary()).cast(pa.string())]
        return f
    return with_columns(docs, [text_col], "n_words bigint, runs array<struct<start:bigint,length:bigint,"
                        "period:bigint>>, collapsed string", start, keep)
