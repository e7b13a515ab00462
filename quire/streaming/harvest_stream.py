"""Incremental harvest (J81): landed responses -> new papers per micro-batch.

Each micro-batch is one harvest over its responses plus any responses held
back by the minimum-batch gate before (the ``pending`` table): normalise,
cap, dedup, anti join with the ledger, gate; then the drop and the ledger
partition named by the responses are written (a replay overwrites them).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from quire.plans.harvest_run import DEFAULT_CONFIG, harvest, responses_id
from quire.schemas import PAPER_COLUMNS, PAYLOADS
from quire.sources.ledger import append_ledger, read_ledger
from quire.sources.sinks import write_drop
from quire.sources.tables import read_table
from quire.streaming.common import run_available


def harvest_stream(spark: SparkSession, landing_dir: str | None, ledger_path: str, drop_dir: str,
                   pending_path: str, checkpoint: str, config: Mapping = DEFAULT_CONFIG,
                   max_files_per_trigger: int | None = None, available_now: bool = True,
                   processing_time: str | None = None, stream: DataFrame | None = None):
    """Harvest the response table in ``landing_dir``, or the responses of
    ``stream`` (such as ``sources.payloads.stream_raw_responses``)."""
    if stream is None:
        reader = spark.readStream.schema(PAYLOADS)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        stream = reader.parquet(landing_dir)
    min_new = int(config.get("min_new_papers", 1))

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        payloads = batch.select(*PAYLOADS.fieldNames()).unionByName(read_table(spark, pending_path, PAYLOADS))
        payloads = payloads.checkpoint(eager=True)  # this batch's input, fixed
        res = harvest(payloads, read_ledger(spark, ledger_path), config, materialize=True)
        new = res.candidates.select(*PAPER_COLUMNS).checkpoint(eager=True)
        n = new.count()
        if n < min_new:
            # below the gate: hold the responses so the papers are found again
            # with the next batch; nothing new at all: nothing to hold
            (payloads if n else payloads.limit(0)).write.mode("overwrite").parquet(pending_path)
            return
        # named by its responses: a replay overwrites its own output, and an
        # epoch counted anew after a lost checkpoint overwrites no other batch
        batch_id = responses_id(payloads)
        write_drop(new, drop_dir, batch_id)
        append_ledger(new, ledger_path, batch_id)
        payloads.limit(0).write.mode("overwrite").parquet(pending_path)

    return run_available(stream.writeStream.foreachBatch(each_batch), checkpoint,
                         available_now, processing_time)
