"""Language identification with hyperdimensional profiles.

Each letter of any script has a random vector of +1 and -1, which a hash of its
code point gives. A letter trigram is the product
(binding) of its letters' vectors, the first rolled by two places and the
second by one, so order matters. The sum (bundle) of its trigrams' vectors is
a text's vector, and that of all texts of a language its prototype. A text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, pieces, quoted, with_columns

SIZE = 1024
SEED = 11
#: Bits of a letter in a trigram's code; 0 is the space between words.
BITS = 21
UNKNOWN = "und"
#: Prototypes that a task holds; they are the only thing sent to all tasks.
MOST_LANGUAGES = 4096
#: Trigram vectors that are held at once.
BLOCK = 1 << 14
#: Cells of a table by which trigrams of a few letters are numbered without sorting.
CELLS = 1 << 24


def symbol(cp: int) -> int:
    """A letter's code point in lower case, 0 for what is no letter."""
    if not chr(cp).isalpha():
        return 0
    low = chr(cp).lower()
    return ord(low) if len(low) == 1 else cp


def symbol_table() -> np.ndarray:
    return np.array([symbol(i) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], np.int64)


def trigrams(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, text number) of each letter trigram: three symbols in a row,
    runs of anything but letters counting as one space, the middle one a letter."""
    joined = "\n".join([t or "" for t in texts]) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = cp >= 0x10000
    sym = table[np.where(high, 0, cp)]
    if high.any():
        kinds, at = np.unique(cp[high], return_inverse=True)
        sym[high] = np.array([symbol(int(k)) for k in kinds], np.int64)[at]
    letter = sym > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + 1 for t in texts])
    x = np.concatenate([[0], sym[keep]])
    owner = np.concatenate([[0], owner[keep]])
    mid = np.flatnonzero(x[1:-1] > 0)
    return np.stack([x[mid], x[mid + 1], x[mid + 2]]), owner[mid + 1]


def numbered(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams as codes, and the place of each trigram among them."""
    kinds = np.flatnonzero(np.bincount(letters.ravel(), minlength=1))
    n = len(kinds)
    if n ** 3 > CELLS:
        return np.unique((letters[0] << 2 * BITS) | (letters[1] << BITS) | letters[2], return_inverse=True)
    place = np.zeros(int(kinds[-1]) + 1 if n else 1, np.int64)
    place[kinds] = np.arange(n)
    key = (place[letters[0]] * n + place[letters[1]]) * n + place[letters[2]]
    found = np.flatnonzero(np.bincount(key, minlength=1))
    at = np.zeros(int(found[-1]) + 1 if len(found) else 1, np.int64)
    at[found] = np.arange(len(found))
    a, rest = np.divmod(found, n * n or 1)
    b, c = np.divmod(rest, n or 1)
    return (kinds[a] << 2 * BITS) | (kinds[b] << BITS) | kinds[c], at[key]


def letter_vectors(letters: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A vector of +1 and -1 for each code point, from a hash of it alone."""
    word = np.arange(-(-size // 64), dtype=np.uint64)
    h = (letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) ^ (word * np.uint64(0xD6E8FEB86659FD93))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(29)
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1)[:, :size]
    return (2 * bits.astype(np.int8) - 1).astype(np.int8)


def bind(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The vector of each trigram."""
    mask = (1 << BITS) - 1
    parts = np.stack([codes >> 2 * BITS, codes >> BITS & mask, codes & mask])
    kinds, at = np.unique(parts, return_inverse=True)
    v, at = letter_vectors(kinds, size), at.reshape(parts.shape)
    return np.roll(v, 2, 1)[at[0]] * np.roll(v, 1, 1)[at[1]] * v[at[2]]


def bundle(codes: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sum of trigram vectors, each so many times."""
    v = np.zeros(size)
    for i in range(0, len(codes), BLOCK):
        v += counts[i:i + BLOCK].astype(np.float64) @ bind(codes[i:i + BLOCK], size).astype(np.float64)
    return v


def text_vectors(texts: list[str | None], table: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The bundle of each text; zeros for a text without letters."""
    letters, owner = trigrams(texts, table)
    codes, place = numbered(letters)
    if len(codes) > BLOCK and len(texts) > 1:
        half = len(texts) // 2
        return np.concatenate([text_vectors(texts[:half], table, size), text_vectors(texts[half:], table, size)])
    out = np.zeros((len(texts), size), np.float32)
    if len(texts) == 1:
        out[0] = bundle(codes, np.bincount(place, minlength=len(codes)), size)
        return out
    vectors = bind(codes, size).astype(np.float32)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(cut)).tolist():
        counts = np.bincount(place[cut[i]:cut[i + 1]])
        at = np.flatnonzero(counts)
        out[i] = counts[at].astype(np.float32) @ vectors[at]
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows with a language. Tasks send
    trigram counts, which Spark sums; parts of them are bundled where they lie
    and the parts of a language added up. The driver gets one vector for each
    language; more than ``MOST_LANGUAGES`` raise a ValueError."""
    src = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"),
                      F.col(quoted(text_col)).alias("t")).where("lang is not null and t is not null")

    def count(batches):
        table = symbol_table()
        for whole in batches:
            for b in pieces(whole, [1]):
                names, at = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
                letters, owner = trigrams(b.column(1).to_pylist(), table)
                codes, place = numbered(letters)
                key, n = np.unique(at[owner] * max(1, len(codes)) + place, return_counts=True)
                lang, code = np.divmod(key, max(1, len(codes)))
                yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()).take(pa.array(lang)), pa.array(codes[code]),
                                                  pa.array(n)], names=["lang", "code", "n"])

    def partly(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object).astype(str)
            code, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in np.unique(lang).tolist():
                at = lang == k
                sums[k] = sums.get(k, 0) + bundle(code[at], n[at], size)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         names=["lang", "v"])

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x, np.float64) for x in pdf["v"])
        return pd.DataFrame({"lang": [key[0]], "v": [v.astype("<f8").tobytes()]})

    counts = src.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    parts = counts.mapInArrow(partly, "lang string, v binary")
    got = parts.groupBy("lang").applyInPandas(added, "lang string, v binary").limit(MOST_LANGUAGES + 1).collect()
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: lang does not hold languages")
    out = {r["lang"]: np.frombuffer(r["v"], "<f8") for r in got}
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(out.items()) if v.any()}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
                     size: int = SIZE, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine with that prototype (0 to
    1), from the whole text alone, in one pass without a shuffle.

    Cases: a null or empty text, or one without letters, is ``und`` with score
    0, as is every text without prototypes; of equal cosines the first
    language in order wins; repeated rows get the same answer. An input column
    named like an output column gives way to it.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), size)
    sent = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def start():
        langs, protos = sent.value
        table = symbol_table()

        def f(col):
            pred, score = [UNKNOWN] * len(col), [0.0] * len(col)
            if langs:
                v = text_vectors(col.to_pylist(), table, size)
                length = np.linalg.norm(v, axis=1)
                cos = v @ protos.T
                for i in np.flatnonzero(length).tolist():
                    k = int(cos[i].argmax())
                    pred[i], score[i] = langs[k], min(1.0, max(0.0, float(cos[i, k] / length[i])))
            return [pred, score]
        return f
    return with_columns(docs, [text_col], "lang_pred string, score double", start, keep)


def training_rows(docs: DataFrame, id_col: str = "doc_id", parts: int = 4, held: int = 2) -> DataFrame:
    """Rows outside the held-out fold of the id."""
    return docs.where(fold(F.col(quoted(id_col)), parts) != held)
