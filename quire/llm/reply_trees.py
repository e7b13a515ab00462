"""Reply trees as chat conversations, with DataFrame operations only.

A tree's messages name their parents. Self-joins double the length of each
message's jump towards the root, so a chain of n messages takes log2(n)
rounds, and carry the scores along. Branches (root to leaf) are ranked by
score; the same jumps then list the messages of the chosen branches, and each
branch becomes one conversation with marked turns and a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, quoted, stored

END = "</turn>\n"
#: The template's control characters and what stands for them.
#: Escaped text holds none of them, so a mark is never part of a text.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(col: Column, table=ESCAPES) -> Column:
    for plain, code in table:
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def unescape(col: Column) -> Column:
    for plain, code in reversed(ROLE_ESCAPES):
        col = F.replace(col, F.lit(code), F.lit(plain))
    return col


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, node, parent, score): the jump tables (tree, node, up, d, s)
    by doubling, and (tree, node, depth, score) of each branch that ends at a
    node. A node whose parent is not in the tree is a root. Nodes on or below
    a cycle of parents reach no root and are left out."""
    total = max(nodes.count(), 1)
    p = nodes.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    step = nodes.join(p, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("parent") == F.col("pn")), "left")
    step = stored(step.select("tree", "node", F.col("pn").alias("up"), F.lit(1).cast("bigint").alias("d"),
                              F.col("score").alias("s")), "jump")
    levels, reach = [step], 1
    while reach <= total and not step.where("up is not null").isEmpty():
        # only messages that have not reached their root jump on
        b = step.select(F.col("tree").alias("bt"), F.col("node").alias("bn"), F.col("up").alias("bu"),
                        F.col("d").alias("bd"), F.col("s").alias("bs"))
        moved = step.where("up is not null").join(
            b, F.col("tree").eqNullSafe(F.col("bt")) & (F.col("up") == F.col("bn")))
        moved = moved.select("tree", "node", F.col("bu").alias("up"), (F.col("d") + F.col("bd")).alias("d"),
                             (F.col("s") + F.col("bs")).alias("s"))
        step = stored(step.where("up is null").unionByName(moved), "jump")
        levels.append(step)
        reach *= 2
    return levels, step.where("up is null").select("tree", "node", F.col("d").alias("depth"), F.col("s").alias("score"))


def best_branches(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, depth, node): the messages of the ``best``
    branches of each tree by the sum of their scores, then by length, then by
    the smaller leaf; depth counts from 0 at the root."""
    nodes = stored(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")),
                   "nodes")
    levels, ends = jumps(nodes)
    parents = levels[0].where("up is not null").select(F.col("tree").alias("pt"), F.col("up").alias("pn")).distinct()
    leaves = ends.join(parents, F.col("tree").eqNullSafe(F.col("pt")) & (F.col("node") == F.col("pn")), "left_anti")
    by_score = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= best)
    path = stored(chosen.select("tree", F.col("node").alias("leaf"), "rank", "score", F.col("depth").alias("n"),
                                "node", F.lit(0).cast("bigint").alias("above")), "paths")
    for k in range(len(levels) - 2, -1, -1):  # the last table has no jumps left
        j = levels[k].where("up is not null").select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "up")
        more = path.join(j, F.col("tree").eqNullSafe(F.col("jt")) & (F.col("node") == F.col("jn")))
        more = more.select("tree", "leaf", "rank", "score", "n", F.col("up").alias("node"),
                           (F.col("above") + F.lit(1 << k)).alias("above"))
        longer = stored(path.unionByName(more), "paths")
        discard(path)
        path = longer
    return path.select("tree", "leaf", "rank", "score", (F.col("n") - 1 - F.col("above")).alias("depth"), "node")


def format_branches(messages: DataFrame, tree_col: str = "tree_id", node_col: str = "node_id",
                    parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text",
                    score_col: str | None = None, best: int = 1, learn_role: str = "assistant") -> DataFrame:
    """One row per chosen branch: ``tree``, ``leaf``, ``rank``, ``score``,
    ``n_turns``, ``formatted`` and ``loss_spans``, the (start, length) in UTF-8
    bytes of each text of ``learn_role``.

    A message becomes ``### role:``, a line feed, its text and ``</turn>``; the
    control characters inside are escaped, reversibly. Without ``score_col``
    each message scores 1. Cases: a null role or text is empty, a null score 0;
    texts of any length are formatted whole;
    messages without an id, or with the id of another of their tree, cannot be
    told apart: of those with one id the first by parent, role and text stays,
    and those without an id are left out; a null tree is a tree of its own; a
    message that answers itself or a cycle is on no branch; an empty table
    gives no rows; other columns are not read.
    """
    src = messages.select(
        F.col(quoted(tree_col)).alias("tree"), F.col(quoted(node_col)).alias("node"),
        F.col(quoted(parent_col)).alias("parent"),
        F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"),
        (F.col(quoted(score_col)) if score_col else F.lit(1.0)).cast("double").alias("score"))
    src = src.where("node is not null").groupBy("tree", "node").agg(
        F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    src = stored(src, "messages")
    path = best_branches(src, best)
    said = src.select(F.col("tree").alias("mt"), F.col("node").alias("mn"), "role", "text")
    rows = path.join(said, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("node") == F.col("mn")))
    head = F.concat(F.lit("### "), escape(F.col("role"), ROLE_ESCAPES), F.lit(":\n"))
    rows = rows.select("tree", "leaf", "rank", "score", "depth", "role", head.alias("head"),
                       escape(F.col("text")).alias("body"))
    size = F.octet_length("head") + F.octet_length("body") + F.lit(len(END))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size.cast("bigint")).over(before), F.lit(0).cast("bigint")))
    turns = F.sort_array(F.collect_list(F.struct(
        "depth", F.concat("head", "body", F.lit(END)).alias("part"),
        (F.col("role") == learn_role).alias("learn"),
        F.struct((F.col("at") + F.octet_length("head")).alias("start"),
                 F.octet_length("body").cast("bigint").alias("length")).alias("span"))))
    out = rows.groupBy("tree", "leaf", "rank", "score").agg(turns.alias("turns"))
    return out.select("tree", "leaf", "rank", "score", F.size("turns").cast("bigint").alias("n_turns"),
                      F.array_join(F.col("turns.part"), "").alias("formatted"),
                      F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation."""
    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, ":\n", 1), 5, 1 << 30)).alias("role"),
        unescape(F.substring(p, F.instr(p, ":\n") + 2, F.length(p))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(
        formatted.cast("binary"), s["start"].cast("int") + 1, s["length"].cast("int")), "UTF-8")))


def chain(rows: DataFrame, tree_col: str, order: list[str]) -> DataFrame:
    """Rows that follow each other in a tree as messages: adds ``node_id`` and
    ``parent_id`` by the order of the columns."""
    w = Window.partitionBy(quoted(tree_col)).orderBy(*map(quoted, order))
    rows = rows.withColumn("node_id", F.row_number().over(w).cast("bigint"))
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))
