"""64-bit hashes of stretches of numbers and of the words of texts, by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: an odd factor of stretch hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are looked at together; a cut falls only where no word is.
CHUNK = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of FACTOR and of its inverse, modulo 2 ** 64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size, one = max(n + 1, 2 * len(self.up)), np.ones(1, np.uint64)
            self.up, self.down = (np.concatenate([one, np.cumprod(np.full(size - 1, f, np.uint64))])
                                  for f in (FACTOR, np.uint64(pow(int(FACTOR), -1, 1 << 64))))
        return self.up, self.down


_powers = Powers()


def stretch_hashes(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of x[first:first + size] for each first and size."""
    up, down = _powers.upto(len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:len(x)], out=total[1:])
    return mixed((total[first + size] - total[first]) * down[first] + size.astype(np.uint64))


#: ASCII white space, and a number for each byte, the same for A-Z and a-z.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = mixed(np.where((np.arange(256) > 64) & (np.arange(256) < 91), np.arange(256) + 32, np.arange(256))
               .astype(np.uint64) * FACTOR + np.uint64(1))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(h, begin): the hashes of the texts' words in order, A-Z lowered, those
    of text i at h[begin[i]:begin[i + 1]]; words are what ASCII white space
    separates. Null is like an empty text. The texts' bytes are looked at in
    chunks, so what is built on the side does not grow with a text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    edges = edges - edges[0]
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data):  # on to a blank or the begin of a text
            edge = int(edges[np.searchsorted(edges, end)])
            blank = np.flatnonzero(_BLANK[data[end:end + CHUNK]])
            if blank.size or edge <= end + CHUNK:
                end = min(edge, end + int(blank[0])) if blank.size else edge
                break
            end += CHUNK
        d = data[at:end]
        word = ~_BLANK[d]
        goes_on = np.zeros(len(d) + 1, bool)  # a word of the place before
        goes_on[1:-1] = word[:-1] & word[1:]
        inner = edges[slice(*np.searchsorted(edges, [at, at + len(d)]))] - at
        goes_on[inner] = False
        first, last = np.flatnonzero(word & ~goes_on[:-1]), np.flatnonzero(word & ~goes_on[1:])
        starts.append(first + at)
        hashes.append(stretch_hashes(_VALUE[d], first, last + 1 - first))
        at += len(d)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), edges)
