"""Harvest planning and bookkeeping: task grid, caps, gate, summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

# Per-source request ceilings applied after the configured limit.
SOURCE_CEILINGS = {"semantic_scholar": 100, "google_scholar": 10}
# Default rows per task and default minimum batch size.
DEFAULT_LIMIT = 20
DEFAULT_MIN_NEW = 1


def source_limits(config: Mapping, known: list[str]) -> dict[str, int]:
    """Enabled and known sources -> row limit (source value, else global, else 20,
    then the source's ceiling). ``config`` has the shape of the harvest config
    file: ``{"max_results_per_source": n, "sources": {name: {"enabled": b, "max_results": n}}}``.
    """
    default = int(config.get("max_results_per_source", DEFAULT_LIMIT))
    out = {}
    for name, cfg in (config.get("sources") or {}).items():
        if not cfg.get("enabled", False) or name not in known:
            continue
        lim = int(cfg.get("max_results", default))
        if name in SOURCE_CEILINGS:
            lim = min(lim, SOURCE_CEILINGS[name])
        out[name] = lim
    return out


def task_grid(keywords: DataFrame, config: Mapping, known: list[str]) -> DataFrame:
    """Every keyword row x every enabled known source, with its row limit.

    ``keywords`` has ``keyword`` and ``keyword_idx``. The source list comes
    from the configuration (bounded by the source registry), so the grid is a
    generator over each keyword row: no join, no shuffle.
    """
    limits = source_limits(config, known)
    if not limits:
        raise ValueError("no enabled source")
    names = [n for n in known if n in limits]  # registry order
    srcs = F.array(*[F.struct(F.lit(n).alias("source"), F.lit(limits[n]).alias("limit"))
                     for n in names])
    return (keywords.select("keyword", F.col("keyword_idx").cast("int").alias("keyword_idx"),
                            F.inline(srcs))
            .select("source", "keyword", "keyword_idx", "limit"))


def top_n_per_group(df: DataFrame, groups: list[str], order: list[Column],
                    n: int, limit_col: str | Column | None = None,
                    rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows of every group by ``order`` (optionally a per-row limit ≤ n).

    The literal bound lets Catalyst insert a partial WindowGroupLimit before
    the shuffle: each map task forwards at most ``n`` rows per group, so a hot
    group costs no more than a cold one after the exchange.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    rn = "_rn" if rank_col is None else rank_col
    out = df.withColumn(rn, F.row_number().over(w))
    cond = F.col(rn) <= F.lit(int(n))
    if limit_col is not None:
        lc = F.col(limit_col) if isinstance(limit_col, str) else limit_col
        cond = cond & (F.col(rn) <= lc)
    out = out.filter(cond)
    if rank_col is None:
        return out.drop(rn)
    return out.withColumn(rn, F.col(rn).cast("long"))


def gate(df: DataFrame, min_new: int = DEFAULT_MIN_NEW) -> DataFrame:
    """All rows when there are at least ``min_new`` of them, else none.

    The count is an uncorrelated scalar subquery (partial + final aggregate),
    evaluated once; the rows are never brought together.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    return df.filter(n >= F.lit(int(min_new)))


def harvest_summary(new_papers: DataFrame, task_status: DataFrame,
                    source_col: str = "source") -> DataFrame:
    """Per source: tasks, failed tasks and new papers; sources without any
    new paper still appear. ``task_status`` has one row per task with ``ok``.
    """
    tasks = task_status.groupBy(source_col).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(~F.col("ok")).alias("errors"))
    new = new_papers.groupBy(source_col).agg(F.count(F.lit(1)).alias("new_papers"))
    return (tasks.join(new, source_col, "left")
            .select(source_col, "tasks", "errors",
                    F.coalesce("new_papers", F.lit(0).cast("long")).alias("new_papers")))
