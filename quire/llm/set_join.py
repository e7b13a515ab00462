"""Similarity join of documents by the Jaccard similarity of their shingle sets,
with PartEnum signatures.

Sets of one size band and the next lower one share an instance: the domain of
shingles is cut by a hash into n partitions, and a set's signature for a
partition is a hash of the part of the set that lies in it. Two sets that reach
the similarity differ in at most d elements, so of any d + 1 partitions they
agree on one. A set gives the first D + 1 + spare partitions, where D is what it
can differ from any partner: at least ``spare`` + 1 of the common ones agree.
Empty parts tell nothing; a set with at most ``spare`` of them leaves them out,
since then one that agrees is not empty.

Sets that share a signature are linked by a star, not by all pairs. A pair is
tested by a parity sketch, which never rejects a similar pair, and then by the
whole sets. Signatures whose sets did not all end in one component are taken up
again, large ones in blocks: of the pairs across components that the sketches
allow, first as many as would join the components are tested, then those that
are still left. So no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import quoted, stored, with_columns
from quire.llm.hashing import FACTOR, mixed, stretch_hashes, word_hashes
from quire.llm.simhash import components

WIDTH, PERCENT = 5, 80
#: Bits of a parity sketch and the columns that hold them; bits of the sharper one for single pairs.
SKETCH, SHARP = 512, 4096
#: Sets with more elements than this are told apart by the sharper one wherever pairs are compared.
SHARP_FROM = 256
SKETCH_COLS = [f"s{i}" for i in range(SKETCH // 64)]
#: Bits of the bounded table that stands for a set of nodes; false hits cost time only.
TABLE_BITS = 26
#: Sets of one signature that are compared at once when it is taken up again.
BLOCK = 2048


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(h, begin): the distinct 64-bit shingle hashes of each text in order,
    those of text i at h[begin[i]:begin[i + 1]]. A text with fewer words than a
    shingle, but not none, is one shingle."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    size = np.where(n >= width, n - width + 1, n > 0)
    begin = np.concatenate([[0], np.cumsum(size)])
    first = np.repeat(at[:-1] - begin[:-1], size) + np.arange(begin[-1])
    h = stretch_hashes(words, first, np.repeat(np.minimum(n, width), size))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][size > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[begin]


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[begin[1:]] - total[begin[:-1]]


def node_numbers(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set; equal sets have equal ones."""
    return mixed(_sums(mixed(h ^ FACTOR), begin) + np.diff(begin).astype(np.uint64)).view(np.int64)


def sketches(h: np.ndarray, begin: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parity sketches, one row of 64-bit words for each set: they differ in no
    more bits than the sets in elements."""
    n = len(begin) - 1
    bit = (mixed(h + FACTOR) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(begin)) * bits + bit, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, -1)


class Bands:
    """Size bands and the numbers of their instances, for a percentage."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent, first, last = percent, [1], []
        while first[-1] <= largest:
            last.append(first[-1] * 100 // percent)
            first.append(last[-1] + 1)
        self.first, self.last = np.array(first[:-1]), np.array(last)
        need = self.differ(self.last, self.last) + 1
        self.spare = 2 + need // 16
        self.parts = need + self.spare

    def differ(self, a, b):
        """The most elements in which sets of these sizes can differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def signatures(self, h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, set): those of every set, by both of its instances."""
        size = np.diff(begin)
        band = np.searchsorted(self.first, size, side="right") - 1
        owner, partner = np.repeat(np.arange(len(size)), size), size * 100 // self.percent
        values, out = mixed(h ^ np.uint64(0xD6E8FEB86659FD93)), []
        for j in (band, band + 1):
            takes = (size > 0) & (partner >= self.first[j])
            given = np.where(takes, self.differ(size, np.minimum(partner, self.last[j])) + 1 + self.spare[j], 0)
            seed = mixed(j.astype(np.uint64) + FACTOR)
            part = (mixed(h ^ seed[owner]) >> np.uint64(32)) * self.parts[j].astype(np.uint64)[owner]
            part = (part >> np.uint64(32)).astype(np.int64)
            offset = np.concatenate([[0], np.cumsum(given)])
            hit = part < given[owner]
            cell = offset[owner[hit]] + part[hit]
            sums, full = np.zeros(offset[-1], np.uint64), np.zeros(offset[-1], bool)
            np.add.at(sums, cell, values[hit])
            full[cell] = True
            holder = np.repeat(np.arange(len(size)), given)
            empty = np.bincount(holder[~full], minlength=len(size))
            kept = full | (empty > self.spare[j])[holder]
            number = np.arange(offset[-1]) - offset[holder]
            sig = mixed(mixed(sums + seed[holder]) + number.astype(np.uint64))
            out.append((sig[kept].view(np.int64), holder[kept]))
        return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out])


def node_table(nodes: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which each node has its bit. What reaches
    the driver is at most 2 ** TABLE_BITS bits."""
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - TABLE_BITS)
    bits = (nodes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")))
    got = bits.toArrow()
    table = np.zeros(1 << TABLE_BITS - 6, np.uint64)
    table[got["w"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table


def _in_table(table: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long is XXH64 of its eight bytes with seed 42."""
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in node.astype("<i8").view("V8").tolist()),
                    np.uint64, len(node)) >> np.uint64(64 - TABLE_BITS)
    return table[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1) > 0


def forest_of(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The edges (a, b), by place, that join nodes of one group not joined yet."""
    top: dict[tuple[int, int], tuple[int, int]] = {}

    def root(v):
        while (w := top.get(v, v)) != v:
            top[v] = v = top.get(w, w)
        return v
    kept = []
    for k, (g, x, y) in enumerate(zip(group.tolist(), a.tolist(), b.tolist())):
        x, y = root((g, x)), root((g, y))
        if x != y:
            top[x] = y
            kept.append(k)
    return kept


class Join:
    """The passes over one document table. Nodes are distinct sets."""

    def __init__(self, docs: DataFrame, text_col: str, width: int, percent: int):
        self.texts = docs.select(F.col(quoted(text_col)).alias("t"))
        self.docs, self.text_col, self.width, self.bands = docs, text_col, width, Bands(percent)
        self.context = docs.sparkSession.sparkContext

    def marked(self, keep: list[str]) -> DataFrame:
        """``keep``, n_shingles, node (null for an empty set) and the sketches."""
        width = self.width

        def start():
            def f(col):
                h, begin = shingle_sets(col, width)
                size = np.diff(begin)
                node = pa.array(node_numbers(h, begin), mask=size == 0)
                sharp = [x.tobytes() for i in range(0, len(size), 500) for x in
                         sketches(h[begin[i]:begin[min(i + 500, len(size))]], begin[i:i + 501] - begin[i], SHARP)]
                return [pa.array(size), node, *(pa.array(np.ascontiguousarray(x)) for x in sketches(h, begin).T),
                        pa.array(sharp, pa.binary())]
            return f
        fields = "n_shingles bigint, node bigint, " + ", ".join(f"{c} bigint" for c in SKETCH_COLS) + ", sharp binary"
        return with_columns(self.docs, [self.text_col], fields, start, keep)

    def _per_set(self, make, schema: str, only: np.ndarray | None = None) -> DataFrame:
        """``make(h, begin, node)`` gives the columns for the sets of a batch,
        each set once in a task; only those of a node table if one is given."""
        width, names = self.width, [f.split()[0] for f in schema.split(", ")]
        given = None if only is None else self.context.broadcast(only)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                for i in range(0, batch.num_rows, 2000):
                    h, begin = shingle_sets(batch.column(0).slice(i, 2000), width)
                    node = node_numbers(h, begin)
                    fresh = np.zeros(len(node), bool)
                    ask = np.diff(begin) > 0
                    if given is not None:
                        ask[ask] = _in_table(given.value, node[ask])
                    for k in np.flatnonzero(ask).tolist():
                        v = int(node[k])
                        if v not in seen:
                            seen.add(v)
                            fresh[k] = True
                    size = np.diff(begin)
                    h = h[np.repeat(fresh, size)]
                    cols = make(h, np.concatenate([[0], np.cumsum(size[fresh])]), node[fresh])
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        return self.texts.mapInArrow(run, schema)

    def signature_rows(self) -> DataFrame:
        """(key, node, other, sig): the sets by signature, which is the key. Of
        the sets of one batch with one signature only the first goes on, marked
        by ``other`` = itself if there are more; the others come as pairs with
        it, dealt by a key of the pair, with their signature."""
        bands = self.bands

        def make(h, begin, node):
            sig, owner = bands.signatures(h, begin)
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[owner[order]]
            head = np.ones(len(sig), bool)
            head[1:] = sig[1:] != sig[:-1]
            first = node[head][np.cumsum(head) - 1] if len(sig) else node
            leads = np.zeros(len(sig), bool)
            leads[:-1] = head[:-1] & ~head[1:]
            key = np.where(head, sig, mixed(node.view(np.uint64) * FACTOR + first.view(np.uint64)).view(np.int64))
            return [pa.array(key), pa.array(node), pa.array(first, mask=head & ~leads), pa.array(sig, mask=head)]
        return self._per_set(make, "key bigint, node bigint, other bigint, sig bigint")

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) that make a star over the sets of each signature, and
        (sig, node): the sets of the signatures that may have three or more."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sig = first = None  # of the signature that may go on in the next batch
            more = False
            for b in batches:
                s, x = b.column(0).to_numpy(), b.column(1).to_numpy()
                y = b.column(2).fill_null(0).to_numpy()
                known = b.column(2).is_valid().to_numpy(zero_copy_only=False)
                local = b.column(3).is_valid().to_numpy(zero_copy_only=False)
                lead = known & ~local
                pairs, held = [np.stack([y[local], x[local]], 1)], [(b.column(3).fill_null(0).to_numpy()[local], x[local])]
                s, x, lead = s[~local], x[~local], lead[~local]
                if len(s):
                    goes_on = sig is not None and s[0] == sig
                    if goes_on:  # as if the first had been in this batch
                        s, x, lead = np.r_[sig, s], np.r_[first, x], np.r_[more, lead]
                    begin = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
                    size = np.diff(np.concatenate([begin, [len(s)]]))
                    any_lead = np.add.reduceat(lead.astype(np.int64), begin) > 0
                    wide = (size > 2) | any_lead
                    wide[-1], wide[0] = True, wide[0] or goes_on  # may be larger than they look here
                    rest = np.ones(len(s), bool)
                    rest[begin] = False
                    pairs.append(np.stack([np.repeat(x[begin], size)[rest], x[rest]], 1))
                    inside = np.repeat(wide, size)
                    held.append((s[inside], x[inside]))
                    sig, first, more = s[-1], x[begin[-1]], bool(any_lead[-1])
                p = np.concatenate(pairs)
                p = p[p[:, 0] != p[:, 1]]
                p.sort(axis=1)
                p = np.unique(p, axis=0)
                sigs, members = (np.concatenate(c) for c in zip(*held))
                none = pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[:, 0], members])), pa.concat_arrays([pa.array(p[:, 1].copy()), none(len(sigs), pa.int64())]),
                     pa.concat_arrays([none(len(p), pa.int64()), pa.array(sigs)])], names=["a", "b", "sig"])
        rows = self.signature_rows().repartition("key").sortWithinPartitions("key", "node")
        found = stored(rows.mapInArrow(run, "a bigint, b bigint, sig bigint"), "candidates")
        return (found.where("sig is null").select("a", "b").distinct(),
                found.where("sig is not null").select("sig", F.col("a").alias("node")).distinct())

    def near(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that sizes and both sketches allow."""
        side = lambda s: nodes.select(F.col("node").alias(s), *(
            F.col(c).alias(f"{s}_{c}") for c in ["size", *SKETCH_COLS]))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        far = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH_COLS])
        p = self.bands.percent
        total = F.col("a_size") + F.col("b_size")
        both = both.where((100 * F.least("a_size", "b_size") >= p * F.greatest("a_size", "b_size"))
                          & (far * (100 + p) <= total * (100 - p))).select("a", "b", total.alias("total"))
        sharp = lambda s: nodes.select(F.col("node").alias(s), F.col("sharp").alias(f"{s}_sharp"))
        both = both.join(sharp("a"), "a").join(sharp("b"), "b").select("a", "b", "total", "a_sharp", "b_sharp")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (3, 4))
                far = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
                ok = pa.array(far * (100 + p) <= b.column(2).to_numpy() * (100 - p))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(ok)
        return both.mapInArrow(run, "a bigint, b bigint")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the similarity."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

        def make(h, begin, node):
            data = pa.py_buffer(np.ascontiguousarray(h))
            at = (begin * 8).astype(np.int64)
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(node), [None, pa.py_buffer(at), data])
            return [pa.array(node), values.cast(pa.binary())]
        sets = self._per_set(make, "node bigint, s binary", node_table(ends)).groupBy("node").agg(F.first("s").alias("s"))
        both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"))
        percent = self.bands.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    z = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                    z.sort()
                    common = int(np.count_nonzero(z[1:] == z[:-1]))
                    good.append(100 * common >= percent * (len(z) - common))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))
        return stored(both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "links")

    def reopened(self, members: DataFrame, nodes: DataFrame, roots: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b) of sets that share a signature but lie in different
        components, allowed by sizes and sketches: ``every`` one, or of each
        signature (or each pair of its blocks) a forest that would join all the
        components that such pairs connect."""
        percent = self.bands.percent
        sharp = "sharp" in nodes.columns  # single pairs of large sets are told apart here, before they are rows
        root = members.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        mixed_sigs = (root.groupBy("sig").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
                      .where("lo <> hi and m > 2").select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
        info = nodes.select("node", "size", *SKETCH_COLS, *([F.when(F.col("size") > SHARP_FROM, F.col("sharp")).alias("sharp")] if sharp else []))
        dealt = (root.join(mixed_sigs, "sig").join(info, "node")
                 .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                 .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("sig", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own",
                         "node", "root", "size", *SKETCH_COLS, *(["sharp"] if sharp else [])))
        last_sketch = 7 + len(SKETCH_COLS)

        def compare(t: np.ndarray) -> np.ndarray:
            """Pairs of rows (sig, x, y, own, node, root, size, sketch..., sharp
            sketch...), whole groups. Only large sets have a sharp sketch."""
            group = np.concatenate([[0], np.cumsum((np.diff(t[:3], axis=1) != 0).any(0))])
            i, d, near = np.arange(t.shape[1]), 0, [np.zeros((0, 2), np.int64)]
            while True:
                d += 1
                i = i[:np.searchsorted(i, t.shape[1] - d)]
                i = i[group[i] == group[i + d]]
                if not i.size:
                    break
                j = i + d
                ok = (t[5][i] != t[5][j]) & ((t[1][i] == t[2][i]) | (t[3][i] != t[3][j]))
                a, b = i[ok], j[ok]
                small, large = np.minimum(t[6][a], t[6][b]), np.maximum(t[6][a], t[6][b])
                ok = 100 * small >= percent * large
                a, b, small, total = a[ok], b[ok], small[ok], (small + large)[ok]
                far = np.bitwise_count((t[7:last_sketch, a] ^ t[7:last_sketch, b]).view(np.uint64)).sum(0, dtype=np.int64)
                ok = far * (100 + percent) <= total * (100 - percent)
                a, b, small, total = a[ok], b[ok], small[ok], total[ok]
                if sharp:
                    large = np.flatnonzero(small > SHARP_FROM)
                    for k in range(0, len(large), 4096):
                        part = large[k:k + 4096]
                        far = np.bitwise_count((t[last_sketch:, a[part]] ^ t[last_sketch:, b[part]]).view(np.uint64)).sum(0, dtype=np.int64)
                        total[part[far * (100 + percent) > total[part] * (100 - percent)]] = -1
                near.append(np.stack([a, b], 1)[total >= 0])
            near = np.concatenate(near)
            if not every:
                near = near[forest_of(group[near[:, 0]], t[5][near[:, 0]], t[5][near[:, 1]])]
            pairs = t[4][near]
            pairs.sort(axis=1)
            return np.unique(pairs, axis=0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None

            def give(t):
                p = compare(t)
                return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])
            for b in batches:
                t = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:last_sketch]])
                if sharp:
                    wide = b"".join(b.columns[last_sketch].fill_null(bytes(SHARP // 8)).to_pylist())
                    t = np.concatenate([t, np.frombuffer(wide, np.int64).reshape(-1, SHARP // 64).T])
                t = t if rest is None else np.concatenate([rest, t], axis=1)
                if not t.shape[1]:
                    continue
                last = np.flatnonzero((t[:3] != t[:3, -1:]).any(0))
                cut = int(last[-1]) + 1 if last.size else 0
                if cut:
                    yield give(t[:, :cut])
                rest = t[:, cut:]  # the last group may go on
            if rest is not None and rest.shape[1]:
                yield give(rest)
        found = dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(run, "a bigint, b bigint")
        return found.distinct()


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_shingles`` (long) and ``component_id``: the smallest id that a
    document reaches over links, where two documents link when their shingle
    sets have a Jaccard similarity of at least ``percent`` per cent.

    Equal sets are one node, so a group of copies of any size costs one. Cases:
    a null, empty or white text has an empty set, 0 shingles, and is linked with
    nothing (its own id is its component); a null id never names a component,
    and ``component_id`` is null where no member has an id; repeated rows all
    stay, with one component; texts of any length are read whole; an empty
    table gives no rows; an input column named like an output column, in any
    case, gives way to it. Shingles and sets are told apart by 64-bit hashes.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_shingles", "component_id")]
    row = docs.select(F.struct(*map(quoted, cols)).alias("row") if cols else F.struct(F.lit(0).alias("_")).alias("row"),
                      F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    join = Join(row, "text", width, percent)
    marked = stored(join.marked(["row", "id"]), "sets")
    nodes = stored(marked.where("node is not null").groupBy("node").agg(
        F.min("id").alias("low"), F.first("n_shingles").alias("size"), *(F.first(c).alias(c) for c in [*SKETCH_COLS, "sharp"])), "nodes")
    pairs, members = join.candidates()
    tested = stored(join.near(pairs, nodes), "near")
    links = join.linked(tested)
    roots = components(links)
    for every in (False, True):  # first as many as would join the components, then all that are left
        more = join.reopened(members, nodes, roots, every).join(tested, ["a", "b"], "left_anti")
        more = stored(join.near(more, nodes), "near")
        if not more.isEmpty():
            tested, links = tested.unionByName(more), links.unionByName(join.linked(more))
            roots = components(links)
    root = F.coalesce("root", "node")
    grouped = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", root.alias("root"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "root").select("node", "component_id")
    out = marked.join(named, "node", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in cols], "n_shingles",
                      F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
