"""SimHash near-duplicate groups with covering locality-sensitive hashing.

Fingerprints have 64 bits. A covering family for radius r has 2^(r+1) - 1
masks: each bit position gets a non-zero vector of r+1 bits, and the mask of a
non-zero v holds the positions whose vector has an odd product with v. At most
r differing positions are r linear conditions on v, so some non-zero v misses
them all: every pair within the radius agrees under some mask. Only pairs that
meet in a bucket are compared, and a bucket gives the edges of a spanning
forest, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, quoted, stored, utf8, with_columns

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members from which a bucket is split by further masks on its free bits.
BUCKET = 32768


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = [0, *ends[:n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b - 1], SEED) for a, b in zip(begin, ends[width - 1:].tolist())],
                    np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        votes += np.unpackbits(h[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = SHINGLE,
                 keep: list[str] | None = None) -> DataFrame:
    """Add ``simhash``, the 64 bits as a signed long. Null, empty and white
    texts have 0; fewer words than a shingle are one shingle."""
    def start():
        def f(col):
            h = [fingerprint(t, width) for t in utf8(col)]
            return [pa.array(np.array(h, np.uint64).view(np.int64))]
        return f
    return with_columns(docs, [text_col], "simhash bigint", start, keep)


def covering_masks(radius: int, free: int = (1 << 64) - 1) -> list[int]:
    """Masks on the bits of ``free`` under one of which any two values agree
    that differ in at most ``radius`` of these bits."""
    vectors = (1 << radius + 1) - 1
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << b for k, b in enumerate(bits) if ((k % vectors + 1) & v).bit_count() & 1)
            for v in range(1, vectors + 1)]


def forest(x: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that join the values of one bucket into the components of the
    'within the radius' graph: a search that compares each reached value with
    the values not reached yet."""
    left, a, b = np.arange(len(x)), [], []
    while left.size > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            i = queue.pop()
            near = np.bitwise_count(x[left] ^ x[i]) <= radius
            if near.any():
                got = left[near].tolist()
                a += [i] * len(got)
                b += got
                queue += got
                left = left[~near]
    return a, b


def _bucket_edges(level: int, radius: int, bucket: int, last: bool):
    """Arrow step over rows (held, key, x) sorted by (held, key): edges of each
    bucket, or its rows again (level + 1) if it has more than ``bucket``."""
    names = ["a", "b", "held", "x"]

    def out(edges=((), ()), again=((), ())):
        n, m = len(edges[0]), len(again[0])
        none = pa.nulls
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(np.array(edges[0], np.int64)), none(m, pa.int64())]),
            pa.concat_arrays([pa.array(np.array(edges[1], np.int64)), none(m, pa.int64())]),
            pa.concat_arrays([none(n, pa.int64()), pa.array(np.array(again[0], np.int64))]),
            pa.concat_arrays([none(n, pa.int64()), pa.array(np.array(again[1], np.int64))])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((3, 0), np.int64)
        large = None  # the bucket whose rows go on to the next level

        def work(t, final):
            nonlocal rest, large
            ea, eb, oh, ox = [], [], [], []
            cut = np.flatnonzero((np.diff(t[0]) != 0) | (np.diff(t[1]) != 0)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [t.shape[1]]])
            if not final:  # the last bucket may go on in the next batch
                if end[-1] - begin[-1] <= bucket or last:
                    rest = t[:, begin[-1]:]
                    begin, end = begin[:-1], end[:-1]
                else:
                    rest = np.empty((3, 0), np.int64)
            size = end - begin
            goes_on = np.zeros(len(size), bool)  # only the first can continue a large bucket
            if large is not None and len(size):
                goes_on[0] = (int(t[0][0]), int(t[1][0])) == large
            i = begin[(size == 2) & ~goes_on]
            if i.size:
                x, y = t[2][i], t[2][i + 1]
                near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius
                ea += x[near].tolist()
                eb += y[near].tolist()
            for r in np.flatnonzero((size > 2) | goes_on).tolist():
                x = t[2][begin[r]:end[r]]
                if not last and (goes_on[r] or size[r] > bucket):
                    large = (int(t[0][begin[r]]), int(t[1][begin[r]]))
                    oh += [large[0]] * len(x)
                    ox += x.tolist()
                else:
                    p, q = forest(np.ascontiguousarray(x).view(np.uint64), radius)
                    ea += x[p].tolist()
                    eb += x[q].tolist()
            return out((ea, eb), (oh, ox))

        for b in batches:
            t = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            t = np.concatenate([rest, t], axis=1)
            rest = np.empty((3, 0), np.int64)
            if t.shape[1]:
                yield work(t, False)
        if rest.shape[1]:
            yield work(rest, True)
    return run


def _masked(radius: int):
    """Arrow step over rows (held, x): x under each covering mask of the bits
    that ``held`` leaves free, joined with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for b in batches:
            held, x = (c.to_numpy().view(np.uint64) for c in b.columns)
            for h in np.unique(held):
                if int(h) not in masks:
                    if len(masks) > 10_000:
                        masks.clear()
                    masks[int(h)] = np.array([int(h) | m for m in covering_masks(radius, ~int(h) & ((1 << 64) - 1))], np.uint64)
                at = x[held == h]
                m = np.tile(masks[int(h)], len(at))
                v = np.repeat(at, len(masks[int(h)]))
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (m, m & v, v)], names=["held", "key", "x"])
    return run


#: Parts over which the members of one component are dealt when they learn its id.
SALTS = 32


def lowest_ids(values: DataFrame, roots: DataFrame) -> DataFrame:
    """(x, component_id): the smallest ``low`` in the component of each value
    (x, low), given (node, root) of the values in larger components. A large
    component is spread over ``SALTS`` parts."""
    members = values.join(roots, values["x"] == roots["node"]).select("x", "low", "root")
    lows = members.groupBy("root").agg(F.min("low").alias("m"))
    ends = values.join(lows, values["x"] == lows["root"]).select(
        F.col("x").alias("root"), F.coalesce(F.least("low", "m"), "low", "m").alias("component_id"))
    spread = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
    of_members = salted.join(spread, ["root", "salt"]).select("x", "component_id")
    of_ends = ends.select(F.col("root").alias("x"), "component_id")
    inside = of_members.unionByName(of_ends)
    alone = values.join(inside.select("x"), "x", "left_anti").select("x", F.col("low").alias("component_id"))
    return inside.unionByName(alone)


def near_edges(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct values (column ``x``, bigint) whose
    components are those of all pairs within ``radius`` bits.

    A bucket above ``bucket`` members is keyed again by covering masks on the
    bits that its mask leaves free; on the fourth level at most 8 bits are
    free, so a bucket has at most 256 values. Nothing is dropped.
    """
    rows, found = values.select(F.lit(0).cast("bigint").alias("held"), "x"), None
    for level in range(4):
        keyed = rows.mapInArrow(_masked(radius), "held bigint, key bigint, x bigint")
        if level:
            keyed = keyed.distinct()
        step = (keyed.repartition("held", "key").sortWithinPartitions("held", "key", "x")
                .mapInArrow(_bucket_edges(level, radius, bucket, level == 3),
                            "a bigint, b bigint, held bigint, x bigint"))
        step = stored(step, f"edges{level}")
        edges = step.where("a is not null").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rows = step.where("a is null").select("held", "x").distinct()
        if rows.isEmpty():
            break
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest value that each node of ``edges`` reaches.

    Alternating large-star and small-star rounds; each halves the distance to
    the root or better, and is written before the next reads it.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .where("u <> v").distinct(), "star")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = stored(small, "star")
        discard(e)
        # settled when no node is both below and above another
        if new.select(F.col("u").alias("n")).join(new.select(F.col("v").alias("n")), "n", "left_semi").isEmpty() and \
                new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = new


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                width: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Add ``simhash`` (signed long) and ``component_id``: the smallest id that
    a document reaches over links of at most ``radius`` differing bits.

    Copies meet as one value first, so a group of copies of any size is one
    node. Cases: null and empty texts have the value 0 and link like any
    other; a null id never names a component, and ``component_id`` is null
    where no member has an id; repeated rows all stay, with the same component.
    An input column named like an output column gives way to it.
    """
    marked = fingerprints(docs, text_col, width,
                          list(dict.fromkeys([*(docs.columns if keep is None else keep), id_col])))
    marked = stored(marked.drop("component_id"), "simhash")
    values = stored(marked.groupBy(F.col("simhash").alias("x")).agg(F.min(quoted(id_col)).alias("low")), "values")
    root = components(near_edges(values, radius))
    by_value = lowest_ids(values, root)
    out = marked.join(by_value, marked["simhash"] == by_value["x"])
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("simhash", "component_id")]
    return out.select(*[marked[quoted(c)] for c in cols], marked["simhash"], by_value["component_id"])
