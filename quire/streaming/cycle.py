"""Full cycle (J83): harvest what has landed, then load the new drops."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.streaming.harvest_stream import harvest_stream
from quire.streaming.load_stream import load_stream


def run_cycle(spark: SparkSession, root: str, landing_dir: str, **kw) -> None:
    """Both jobs with availableNow triggers, state under ``root``; loaded drops
    go to its archive."""
    harvest_stream(spark, landing_dir, f"{root}/ledger", f"{root}/drops", f"{root}/pending",
                   f"{root}/ckpt/harvest", **kw)
    load_stream(spark, f"{root}/drops", f"{root}/papers", f"{root}/log", f"{root}/ckpt/load",
                archive_dir=f"{root}/archive")
