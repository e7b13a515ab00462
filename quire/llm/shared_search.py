"""Ranked lexical search for many items at once, with shared parts scored once.

The items' term sets are mined for sets that several items hold: terms lie in
each item's list by falling number of items, and neighbours that at least two
lists have in common become one node, round after round. The nodes form a
directed acyclic graph. For a block of documents each term's scores are written
once, each shared node's accumulator is the sum of its two parts, and an item's
scores are the sum over the nodes that are left in its list.

Documents are tokenised once for a block of items: the counts of the items'
terms go to a table, from which the corpus statistics and then the scores are
taken. Only the best of a task leave it.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import quoted, stored, utf8, with_columns

#: Bytes of item texts of a block, whose terms and graph go to every task.
ITEM_BYTES = 2 << 20
#: Numbers of one matrix of accumulators (nodes times documents).
CELLS = 4 << 20
#: Letters and digits of ASCII stay, capitals are lowered, all else of ASCII separates.
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWERED).split() if text else []


class Graph:
    """Items over shared nodes. Nodes 0.. are the terms; ``levels`` holds, round
    by round, the two parts of each further node; ``lists`` the nodes whose sum
    an item is."""

    def __init__(self, terms: list[bytes], levels: list[np.ndarray], lists: list[list[int]]):
        self.terms, self.levels, self.lists = terms, levels, lists
        self.nodes = len(terms) + sum(len(x) for x in levels)

    @classmethod
    def mine(cls, items: list[set[bytes]]) -> Graph:
        holders: dict[bytes, list[int]] = defaultdict(list)
        for i, terms in enumerate(items):
            for t in terms:
                holders[t].append(i)
        # by falling number of items; terms of the same items side by side
        terms = sorted(holders, key=lambda t: (-len(holders[t]), holders[t], t))
        number = {t: k for k, t in enumerate(terms)}
        lists = [sorted(number[t] for t in x) for x in items]
        levels, n = [], len(terms)
        while True:
            pairs = Counter(chain.from_iterable(zip(x, x[1:]) for x in lists))
            taken: list[list[int]] = []  # where each list's pairs begin
            for x in lists:
                at, k = [], 0
                while k + 1 < len(x):
                    c = pairs[x[k], x[k + 1]]
                    if c > 1 and (k + 2 == len(x) or c >= pairs[x[k + 1], x[k + 2]]):
                        at.append(k)
                        k += 1
                    k += 1
                taken.append(at)
            used = Counter((x[k], x[k + 1]) for x, at in zip(lists, taken) for k in at)
            made = {p: n + k for k, p in enumerate(sorted(p for p, c in used.items() if c > 1))}
            if not made:
                return cls(terms, levels, lists)
            for i, (x, at) in enumerate(zip(lists, taken)):
                begins = {k for k in at if (x[k], x[k + 1]) in made}
                lists[i] = [made[x[k], x[k + 1]] if k in begins else v for k, v in enumerate(x) if k - 1 not in begins]
            levels.append(np.array(list(made), np.int64))
            n += len(made)

    def additions(self) -> int:
        """Vector additions that all items take."""
        return self.nodes - len(self.terms) + sum(max(0, len(x) - 1) for x in self.lists)

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """Item scores (items x documents) from the terms' (terms x documents)."""
        acc = np.zeros((self.nodes, leaves.shape[1]), np.int64)
        acc[:len(self.terms)] = leaves
        at = len(self.terms)
        for parts in self.levels:
            np.add(acc[parts[:, 0]], acc[parts[:, 1]], out=acc[at:at + len(parts)])
            at += len(parts)
        out = np.zeros((len(self.lists), leaves.shape[1]), np.int64)
        for i, nodes in enumerate(self.lists):
            if nodes:
                acc[nodes].sum(0, out=out[i])
        return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, graph, ids): a graph for each block of items, built where Spark
    gathers the block."""
    src = items.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"))
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    id_type = src.schema["id"].dataType.simpleString()

    def build(t: pa.Table) -> pa.Table:
        graph = Graph.mine([set(terms_of(x)) for x in t.column("t").cast(pa.binary()).to_pylist()])
        ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("id").combine_chunks())
        return pa.table([t.column("block")[:1], pa.array([pickle.dumps(graph)], pa.binary()), ids],
                        names=["block", "graph", "ids"])
    numbered = src.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return stored(numbered.groupBy("block").applyInArrow(build, f"block bigint, graph binary, ids array<{id_type}>"),
                  "graphs")


def count_terms(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """(id, n, terms, tf): the number of terms of each document that has any,
    and its counts of the listed ones, by their numbers."""
    src = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t"))
    given = docs.sparkSession.sparkContext.broadcast(terms)

    class Numbers(dict):
        def __missing__(self, term):
            return -1

    def start():
        number = Numbers((t, i) for i, t in enumerate(given.value))

        def f(col):
            found = [terms_of(t) for t in utf8(col)]
            n = np.array([len(x) for x in found], np.int64)
            ids = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, n.sum())
            key = np.repeat(np.arange(len(n)), n) * (len(number) + 1) + ids
            key, tf = np.unique(key[ids >= 0], return_counts=True)
            doc, term = np.divmod(key, len(number) + 1)
            at = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
            return [pa.array(n)] + [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, tf)]
        return f
    counted = with_columns(src, ["t"], "n bigint, terms array<int>, tf array<int>", start, keep=["id"])
    return stored(counted.where("n > 0"), "counts")


def statistics(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and documents of each listed term. What reaches
    the driver is one count for each term of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            docs += b.num_rows
            total += int(b.column(0).to_numpy().sum())
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])),
                                          pa.array(np.concatenate([[docs, total], df[at]]))], names=["term", "n"])
    sums = counted.select("n", "terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in sums.collect()}
    docs, total = got.pop(-2, 0), got.pop(-1, 0)
    df = np.zeros(n_terms, np.int64)
    df[list(got)] = list(got.values())
    return docs, total, df


def _best_of_tasks(counted: DataFrame, graph: Graph, n_docs: int, total: int, df: np.ndarray, k: int) -> DataFrame:
    """(place, id, score): of each task at least the ``k`` best documents of each
    item, by score and then by id."""
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    given = counted.sparkSession.sparkContext.broadcast((graph, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights = given.value
        best = np.zeros((len(graph.lists), k), np.int64)  # scores so far, ascending
        step = max(1, CELLS // max(1, graph.nodes))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                b = batch.slice(i, step)
                b = b.take(pc.sort_indices(b.column(0), null_placement="at_end"))  # ties: the first column first
                m = np.array([10 + 90 * n * n_docs // total for n in b.column(1).to_pylist()], np.int64)
                sizes = pc.list_value_length(b.column(2)).to_numpy()
                doc, term = np.repeat(np.arange(b.num_rows), sizes), b.column(2).flatten().to_numpy()
                tf = b.column(3).flatten().to_numpy().astype(np.int64)
                leaves = np.zeros((len(weights), b.num_rows), np.int64)
                leaves[term, doc] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                scores = graph.scores(leaves)
                first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(scores, first, 1)
                good = (top > 0) & (top >= best[:, :1])
                best = np.sort(np.concatenate([best, top], axis=1), axis=1)[:, -k:]
                item, at = np.nonzero(good)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item), b.column(0).take(pa.array(first[item, at])), pa.array(top[item, at])],
                    names=["place", "id", "score"])
    id_type = counted.schema["id"].dataType.simpleString()
    return counted.mapInArrow(run, f"place bigint, id {id_type}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text",
                   block_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row for each item and each of its ``k`` best documents with a score
    above 0: ``item_id``, ``rank`` (int, from 1), ``doc_id``, ``score`` (long).

    Items go in blocks of about ``block_bytes`` of text, each with one pass over
    the documents; what a task holds is bounded by a block's terms. Equal scores
    go by ascending id, null ids last. Cases: null and empty texts have no
    terms, such documents count nowhere and such items get no rows; each of
    repeated rows is a document, or an item, of its own; texts of any length are
    read whole; without documents or items there are no rows; other columns
    are not read.
    """
    blocks = _item_blocks(items, item_id_col, item_text_col, block_bytes)
    parts = None
    for row in blocks.select("block").sort("block").collect():
        graph = pickle.loads(blocks.where(F.col("block") == row["block"]).first()["graph"])
        counted = count_terms(docs, id_col, text_col, graph.terms)
        n_docs, total, df = statistics(counted, len(graph.terms))
        found = _best_of_tasks(counted, graph, n_docs, total, df, k).withColumn("block", F.lit(row["block"]))
        parts = found if parts is None else parts.unionByName(found)
    ids = blocks.select("block", F.posexplode("ids").alias("place", "item_id"))
    if parts is None:
        parts = docs.select(F.lit(0).cast("bigint").alias("place"), F.col(quoted(id_col)).alias("id"),
                            F.lit(0).cast("bigint").alias("score"), F.lit(0).cast("bigint").alias("block")).limit(0)
    by = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = parts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(ids, ["block", "place"]).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
