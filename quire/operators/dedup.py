"""Key dedup inside a run and the anti join against the ledger of known keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAPER_KEY = ["site_name", "paper_number"]


def dedup_first(df: DataFrame, keys: list[str] = PAPER_KEY,
                order: list[str | Column] | None = None) -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple wins.

    Planned as a hash aggregate with ``min_by``: every map task first reduces
    its own rows to one per key (partial aggregation), so a key that holds a
    large share of the data never reaches one reducer as raw rows.
    """
    order = order or ["keyword_idx", "item_pos"]
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    others = [c for c in df.columns if c not in keys]
    # a hash of the rest of the row breaks ties of the order keys, so the winner
    # is deterministic and the row crosses the shuffle once (maps and variants
    # cannot be hashed and are left out)
    hashable = [f.name for f in df.schema.fields if f.name in others
                and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rank = F.struct(*order_cols, F.xxhash64(*hashable).alias("_tie")) if hashable else F.struct(*order_cols)
    winner = F.min_by(F.struct(*[F.col(c) for c in others]), rank).alias("_w")
    return df.groupBy(*keys).agg(winner).select(*keys, "_w.*").select(*df.columns)


def new_vs_ledger(df: DataFrame, ledger: DataFrame, keys: list[str] = PAPER_KEY) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ledger`` (exact, case-sensitive).

    A sort-merge anti join. Beside a ledger in buckets by its key
    (``sources.ledger``) only ``df`` is shuffled: each bucket is read by the task
    that has the rows of its hash. A ledger that is no such table is shuffled too.
    """
    return df.join(ledger.select(*keys), keys, "left_anti")


def new_vs_ledger_keys(df: DataFrame, ledger: DataFrame, keys: list[str], most_keys: int) -> DataFrame:
    """The same for a batch of at most ``most_keys`` keys, which the caller vouches
    for and which is checked: its keys are broadcast into the ledger scan, and
    the hits among them back, so a ledger in any layout is read where it lies."""
    batch_keys = df.select(*keys).distinct()
    n = batch_keys.limit(most_keys + 1).count()
    if n > most_keys:
        raise ValueError(f"the batch has more than {most_keys} keys")
    hits = ledger.select(*keys).join(F.broadcast(batch_keys), keys, "left_semi").distinct()
    return df.join(F.broadcast(hits), keys, "left_anti")


def drop_blank_keys(df: DataFrame, col: str = "paper_number") -> DataFrame:
    """Rows with an empty or missing paper number never count."""
    return df.filter(F.length(F.col(col)) > 0)
