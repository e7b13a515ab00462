"""One harvest run as a single plan up to its two writes.

payloads -> normalise every source -> cap the rows of each response ->
drop blank keys -> first arrival per key -> anti join with the ledger ->
minimum-batch gate -> CSV drop + ledger append; plus a per-source summary.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quire.operators.dedup import PAPER_KEY, dedup_first, drop_blank_keys, new_vs_ledger
from quire.operators.harvest import DEFAULT_MIN_NEW, gate, harvest_summary, source_limits
from quire.schemas import PAPER_COLUMNS
from quire.session import checkpoint_root
from quire.sources import normalisers as N
from quire.sources.dead_letters import settle
from quire.sources.ledger import append_ledger
from quire.sources.sinks import write_drop

# The shipped harvest configuration (keywords are supplied by
# the run): rows per task, minimum new rows to write, and the sources.
DEFAULT_CONFIG = {
    "max_results_per_source": 20,
    "min_new_papers": 3,
    "sources": {
        "arxiv": {"enabled": True},
        "semantic_scholar": {"enabled": True},
        "openalex": {"enabled": True},
        "crossref": {"enabled": True},
        "europepmc": {"enabled": True},
        "core": {"enabled": True},
        "base": {"enabled": True},
        "google_scholar": {"enabled": True, "max_results": 5},
        "ieee_xplore": {"enabled": True},
        "plos": {"enabled": True},
        "doaj": {"enabled": True},
    },
}


@dataclass
class HarvestResult:
    new_papers: DataFrame      # gated rows to write (PAPER_RAW + task columns)
    summary: DataFrame         # per source: tasks, errors, new_papers
    candidates: DataFrame      # new rows before the gate
    status: DataFrame          # one row per response: source, keyword, keyword_idx, ok


def capped_rows(payloads: DataFrame, config: Mapping = DEFAULT_CONFIG,
                parsed: DataFrame | None = None) -> DataFrame:
    """Normalised rows, at most the source's limit from each response (the
    limit is what a request asks for), in the source's declared order (newest
    date first, else as they came). A response is one row with its records, so
    the cap is taken inside the row: nothing is shuffled or ranked, and
    responses of other runs never share an allowance."""
    limits = source_limits(config, N.SOURCES)
    sources = [s for s in N.SOURCES if s in limits]
    parsed = parsed if parsed is not None else N.parse_payloads(
        payloads.where(F.col("source").isin(*sources)), sources)
    lim = F.element_at(F.create_map(*[x for s in sources for x in (F.lit(s), F.lit(limits[s]))]),
                       F.col("source"))
    usable = F.filter("papers", lambda r: r["keep"])
    newest = F.array_sort(usable, _newest_first)
    ordered = F.when(F.col("source").isin(*N.DATE_ORDERED), newest).otherwise(usable)
    return N.rows_of(parsed.withColumn("papers", F.slice(ordered, F.lit(1), lim)))


def _newest_first(a, b):
    """Order of two records: date descending, no date last, then position."""
    x, y = a["sort_date"], b["sort_date"]
    by_date = F.when(x > y, -1).when(x < y, 1).when(x.isNotNull() & y.isNull(), -1) \
        .when(x.isNull() & y.isNotNull(), 1)
    return F.coalesce(by_date, a["item_pos"] - b["item_pos"])


def responses_id(payloads: DataFrame) -> str:
    """A batch id from what landed: the same responses give the same id, so a
    repeat after a crash replaces the drop and ledger partition of the first
    try, and other responses never do."""
    r = payloads.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(
        "source", "keyword", "fetched_at", "file_path", "body")).alias("x")).first()
    return f"r{r.n}-{(r.x or 0) & ((1 << 64) - 1):016x}"


def harvest(payloads: DataFrame, ledger: DataFrame, config: Mapping = DEFAULT_CONFIG,
            materialize: bool = False) -> HarvestResult:
    """The run as lazy DataFrames. Every response is parsed once; with
    ``materialize`` the parsed responses are checkpointed first so the rows
    and the per-task status come from one parse even across jobs."""
    min_new = int(config.get("min_new_papers", DEFAULT_MIN_NEW))
    limits = source_limits(config, N.SOURCES)
    sources = [s for s in N.SOURCES if s in limits]
    parsed = N.parse_payloads(payloads.where(F.col("source").isin(*sources)), sources)
    if materialize:
        checkpoint_root(payloads.sparkSession)
        parsed = parsed.checkpoint(eager=True)
    keyed = drop_blank_keys(capped_rows(payloads, config, parsed))
    first = dedup_first(keyed, PAPER_KEY, ["keyword_idx", "item_pos"])
    new = new_vs_ledger(first, ledger, PAPER_KEY)
    status = N.task_status(payloads, parsed=parsed)
    return HarvestResult(gate(new, min_new), harvest_summary(new, status), new, status)


def gated_batch(result: HarvestResult, config: Mapping = DEFAULT_CONFIG) -> DataFrame:
    """The run's new rows, computed once (checkpointed) and gated by their
    count: all of them, or none below ``min_new_papers``."""
    batch = result.candidates.checkpoint(eager=True)
    if batch.count() < int(config.get("min_new_papers", DEFAULT_MIN_NEW)):
        return batch.limit(0)
    return batch


def run_harvest(payloads: DataFrame, ledger: DataFrame, ledger_path: str, drop_dir: str,
                batch_id: str | None = None, config: Mapping = DEFAULT_CONFIG,
                letters_path: str | None = None) -> tuple[str | None, DataFrame]:
    """Execute a run: the new rows are checkpointed to the shared checkpoint
    folder so the gate and both writes see the same rows; below the gate
    nothing is written (path None), else the drop and the ledger partition of
    ``batch_id`` (by default from the responses) are written, drop first. With
    ``letters_path`` failed responses are kept there, and mended ones that are
    among ``payloads`` are settled (``sources.dead_letters``)."""
    checkpoint_root(payloads.sparkSession)
    if letters_path:
        settle(payloads, letters_path, batch_id or responses_id(payloads), list(source_limits(config, N.SOURCES)))
    result = harvest(payloads, ledger, config, materialize=True)
    # the new rows are computed once; the gate is their count, the summary
    # counts them per source
    cand = result.candidates.checkpoint(eager=True)
    summary = harvest_summary(cand, result.status)
    if cand.count() < int(config.get("min_new_papers", DEFAULT_MIN_NEW)):
        return None, summary
    batch = cand.select(*PAPER_COLUMNS)
    batch_id = batch_id or responses_id(payloads)
    path = write_drop(batch, drop_dir, batch_id)
    append_ledger(batch, ledger_path, batch_id)
    return path, summary
