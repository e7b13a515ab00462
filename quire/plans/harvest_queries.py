"""Registered queries for the harvest side: dedup, ledger, gate, summary,
task grid, per-task caps, and a whole run over every source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import dedup as D
from quire.operators import harvest as H
from quire.plans import harvest_run as R
from quire.plans import payload_fixtures as PF
from quire.plans.catalog import register
from quire.plans.fixtures import PAPERS_FX_SQL, papers_fx, table, with_views
from quire.plans.source_queries import AB_SQL, BASE_SQL, select_sql
from quire.schemas import PAPER_COLUMNS
from quire.sources import normalisers as N
from quire.session import scratch_path
from quire.sources.dead_letters import pending_letters
from quire.sources.ledger import append_ledger, compact_ledger, read_ledger
from quire.sources.payloads import land_payloads, land_raw_responses, read_payloads, read_raw_responses

EVENT_COLS = "event_id, ts, user_id, event_type, value, props"
LEDGER_CUT = "2024-01-10 00:00:00"


@register("dedup_first", f"""
SELECT {EVENT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS rn
  FROM events) WHERE rn = 1""")
def dedup_first(spark, sf_dir):
    """First arrival per key (J32): key = (event_type, user_id), order = (ts, event_id)."""
    ev = table(spark, sf_dir, "events")
    return D.dedup_first(ev, ["event_type", "user_id"], ["ts", "event_id"])


_NEW_SQL = f"""
SELECT {EVENT_COLS} FROM events e
WHERE e.ts >= TIMESTAMP '{LEDGER_CUT}'
  AND NOT EXISTS (SELECT 1 FROM events l WHERE l.ts < TIMESTAMP '{LEDGER_CUT}'
                  AND l.event_type = e.event_type AND l.user_id = e.user_id)"""


def _ledger_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cut = F.lit(LEDGER_CUT).cast("timestamp_ntz")
    return ev.filter(F.col("ts") >= cut), ev.filter(F.col("ts") < cut)


@register("new_vs_ledger", _NEW_SQL)
def new_vs_ledger(spark, sf_dir):
    """Anti join with the ledger of known keys (J31), shuffle plan."""
    batch, ledger = _ledger_split(spark, sf_dir)
    return D.new_vs_ledger(batch, ledger, ["event_type", "user_id"])


@register("new_vs_ledger_broadcast", _NEW_SQL)
def new_vs_ledger_broadcast(spark, sf_dir):
    """Same anti join, small-batch plan: the batch's keys, checked against a
    bound, are broadcast into the ledger scan."""
    batch, ledger = _ledger_split(spark, sf_dir)
    return D.new_vs_ledger_keys(batch, ledger, ["event_type", "user_id"], most_keys=500_000)


def _ledger_of_events(spark, sf_dir):
    """The events before the cut as a ledger of two harvests, then compacted;
    a third harvest is written twice, as after a crash. The event type plays
    the site: a few hot ones."""
    batch, old = _ledger_split(spark, sf_dir)
    as_key = {"site_name": F.col("event_type"), "paper_number": F.col("user_id").cast("string")}
    old = old.withColumns(as_key).withColumn("extracted_at", F.col("ts").cast("string"))
    path = f"{scratch_path(spark, 'ledger')}/ledger"
    for k, harvest in enumerate(("b0", "b1", "b2", "b2")):
        append_ledger(old.where(F.pmod("event_id", F.lit(3)) == int(harvest[1])), path, harvest)
        if k == 1:
            compact_ledger(spark, path)
    return batch.withColumns(as_key), read_ledger(spark, path)


@register("new_vs_ledger_buckets", _NEW_SQL)
def new_vs_ledger_buckets(spark, sf_dir):
    """The anti join (J31) with a ledger in buckets (J04, J07): only the batch
    is shuffled."""
    batch, ledger = _ledger_of_events(spark, sf_dir)
    new = D.new_vs_ledger(batch, ledger.hint("merge"))
    return new.select(*EVENT_COLS.split(", "))


@register("gate_min_new", with_views(PAPERS_FX_SQL) + """
SELECT seq, site_name, paper_number FROM papers_fx
WHERE (SELECT count(*) FROM papers_fx) >= 3""")
def gate_min_new(spark, sf_dir):
    """Minimum-batch gate (J34) over all papers: passes (enough rows)."""
    return H.gate(papers_fx(spark, sf_dir), 3).select("seq", "site_name", "paper_number")


@register("gate_blocks_small_batch", with_views(PAPERS_FX_SQL) + """
SELECT b.site_name, b.n, CASE WHEN b.n >= a.n THEN b.n ELSE 0 END AS passed
FROM (SELECT site_name, count(*) AS n FROM papers_fx GROUP BY site_name) b,
     (SELECT avg(n) AS n FROM (SELECT count(*) AS n FROM papers_fx GROUP BY site_name)) a""")
def gate_blocks_small_batch(spark, sf_dir):
    """Gate (J34) on each site's batch with the mean batch size as threshold:
    the smaller batches are held back whole, the larger ones pass whole."""
    papers = papers_fx(spark, sf_dir).select("site_name", "seq")
    sizes = papers.groupBy("site_name").agg(F.count(F.lit(1)).alias("n"))
    need = -(-papers.count() // max(sizes.count(), 1))
    batches = [r.site_name for r in sizes.select("site_name").collect()]  # the sites: a handful of sources
    passed = None
    for site in batches:
        g = H.gate(papers.where(F.col("site_name").eqNullSafe(site)), need)
        passed = g if passed is None else passed.unionByName(g)
    got = passed.groupBy("site_name").agg(F.count(F.lit(1)).alias("passed"))
    return sizes.join(got, "site_name", "left").select("site_name", "n", F.coalesce("passed", F.lit(0)).alias("passed"))


@register("harvest_summary", """
SELECT 's' || cast(user_id % 7 AS varchar) AS source, count(*) AS tasks,
       count(*) FILTER (WHERE event_type = 'error') AS errors,
       count(*) FILTER (WHERE event_type <> 'error') AS new_papers
FROM events GROUP BY 1""")
def harvest_summary(spark, sf_dir):
    """Per-source tasks, failed tasks and new rows (J33) over task outcomes
    shaped from events (failed task = an 'error' event)."""
    ev = table(spark, sf_dir, "events").withColumn(
        "source", F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")))
    status = ev.select("source", (F.col("event_type") != "error").alias("ok"))
    new = ev.filter(F.col("event_type") != "error").select("source")
    return H.harvest_summary(new, status)


_GRID_VALUES = ", ".join(
    "('{}', {})".format(n, R.DEFAULT_CONFIG["sources"][n].get("max_results", "NULL"))
    for n in N.SOURCES)


@register("task_grid", f"""
SELECT s.source, p.p_name AS keyword, cast(p.p_partkey AS int) AS keyword_idx,
       least(coalesce(s.max_results, 20),
             CASE s.source WHEN 'semantic_scholar' THEN 100 WHEN 'google_scholar' THEN 10
                           ELSE 2147483647 END) AS "limit"
FROM part p CROSS JOIN (VALUES {_GRID_VALUES}) AS s(source, max_results)""")
def task_grid(spark, sf_dir):
    """Keyword x enabled-source grid with row limits (J11, J12); one keyword
    entry per ``part`` row (so the grid grows with the data), sources from
    the shipped configuration."""
    kw = table(spark, sf_dir, "part").select(F.col("p_name").alias("keyword"),
                                             F.col("p_partkey").alias("keyword_idx"))
    return H.task_grid(kw, R.DEFAULT_CONFIG, N.SOURCES)


@register("cap_per_task", """
SELECT source, lang, doc_id, n_chars, cast(rk AS bigint) AS rank FROM (
  SELECT source, lang, doc_id, n_chars,
         row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rk
  FROM documents) WHERE rk <= 3""")
def cap_per_task(spark, sf_dir):
    """Top 3 per (source, lang) by n_chars desc (J13), skew-safe group limit."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return H.top_n_per_group(docs, ["source", "lang"],
                             [F.col("n_chars").desc(), F.col("doc_id").asc()], 3, rank_col="rank")


# ---- a whole harvest run over every source -------------------------------

def _harvest_ctes(tag: str, where: str, ledger: str | None) -> str:
    parts = []
    for i, s in enumerate(N.SOURCES):
        sd = {"arxiv": "CASE WHEN date_raw IS NOT NULL THEN concat(date_raw, 'T08:00:00Z') END",
              "openalex": "date_raw"}.get(s)
        if s == "crossref":
            from quire.plans.source_queries import CROSSREF_DATE
            sd = CROSSREF_DATE
        extra = (f"'{s}' AS src, chunk % 20 AS keyword_idx, item_pos, "
                 f"chunk, {sd or 'cast(NULL AS varchar)'} AS sort_date, ")
        parts.append(select_sql(s, src=f"{tag}_d", where=f"k = {i}", extra=extra))
    rows = "\nUNION ALL\n".join(parts)
    anti = "TRUE" if ledger is None else (
        f"NOT EXISTS (SELECT 1 FROM {ledger} l WHERE l.site_name = f.site_name "
        f"AND l.paper_number = f.paper_number)")
    return f""",
{tag}_d AS (SELECT dd.*, row_number() OVER (PARTITION BY k, chunk ORDER BY doc_id) - 1 AS item_pos
            FROM dd WHERE {where}),
{tag}_rows AS ({rows}),
{tag}_capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, chunk
                 ORDER BY sort_date DESC NULLS LAST, item_pos) AS rn FROM {tag}_rows)
                 WHERE rn <= CASE WHEN src = 'google_scholar' THEN 5 ELSE 20 END),
{tag}_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_name, paper_number
                ORDER BY keyword_idx, item_pos) AS r2 FROM {tag}_capped WHERE length(paper_number) > 0)
                WHERE r2 = 1),
{tag}_new AS (SELECT * FROM {tag}_first f WHERE {anti}),
{tag}_gated AS (SELECT * FROM {tag}_new WHERE (SELECT count(*) FROM {tag}_new) >= 3)"""


HARVEST_SQL = BASE_SQL + AB_SQL + _harvest_ctes("r1", "lang = 'en'", None) \
    + _harvest_ctes("r2", "TRUE", "r1_gated")
_SUMMARY_TASKS = """,
tasks AS (SELECT src, count(*) + count(*) FILTER (WHERE broken) AS tasks,
                 count(*) FILTER (WHERE broken AND src <> 'google_scholar') AS errors
          FROM (SELECT DISTINCT k, chunk, (chunk + k) % 13 = 7 AS broken FROM dd) t
          JOIN (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, '{s}')" for i, s in enumerate(N.SOURCES)) + """) AS v(k, src)) USING (k)
          GROUP BY src)
"""


def _run(spark, sf_dir):
    """Two runs as they happen: responses land (J01); the earlier run writes
    its drop and ledger (J06, J07); the later run reads the ledger (J04)."""
    root = scratch_path(spark, "harvest")
    srcs = N.SOURCES
    land_payloads(PF.mixed_payloads(spark, sf_dir, srcs, lang="en"), f"{root}/landing1")
    land_payloads(PF.mixed_payloads(spark, sf_dir, srcs), f"{root}/landing2")
    R.run_harvest(read_payloads(spark, f"{root}/landing1"), read_ledger(spark, f"{root}/ledger"),
                  f"{root}/ledger", f"{root}/drops", "run1")
    return R.harvest(read_payloads(spark, f"{root}/landing2"), read_ledger(spark, f"{root}/ledger"),
                     materialize=True)


@register("harvest_new_papers", HARVEST_SQL + "\nSELECT " + ", ".join(PAPER_COLUMNS) + " FROM r2_gated")
def harvest_new_papers(spark, sf_dir):
    """Flagship harvest: every source's responses -> caps -> dedup -> minus
    the keys of an earlier run (English documents) -> gate."""
    return R.gated_batch(_run(spark, sf_dir)).select(*PAPER_COLUMNS)


@register("harvest_run_summary", HARVEST_SQL + _SUMMARY_TASKS + """
SELECT t.src AS source, t.tasks, t.errors, coalesce(n.c, 0) AS new_papers
FROM tasks t LEFT JOIN (SELECT src, count(*) AS c FROM r2_new GROUP BY src) n USING (src)""")
def harvest_run_summary(spark, sf_dir):
    """Per-source summary of the flagship run."""
    res = _run(spark, sf_dir)
    return H.harvest_summary(res.candidates.checkpoint(eager=True), res.status)


def raw_landing(spark, sf_dir, root: str, lang: str | None = None) -> list[str]:
    """The stand-in responses of all sources as raw files; the keywords."""
    pay = PF.mixed_payloads(spark, sf_dir, N.SOURCES, lang=lang)
    land_raw_responses(pay, root)
    found = {r.keyword_idx: r.keyword for r in pay.select("keyword_idx", "keyword").distinct().collect()}  # 20 keywords
    return [found.get(i, "") for i in range(max(found, default=-1) + 1)]


#: A raw file's fetch time is when it was written: no SQL knows it.
RAW_COLUMNS = [c for c in PAPER_COLUMNS if c != "extracted_at"]


@register("harvest_raw_files", HARVEST_SQL + "\nSELECT " + ", ".join(RAW_COLUMNS) + " FROM r2_gated")
def harvest_raw_files(spark, sf_dir):
    """The flagship harvest over raw response files of all sources (J01): an
    earlier run over English documents, then all, against its ledger."""
    root = scratch_path(spark, "harvest")
    keywords = raw_landing(spark, sf_dir, f"{root}/raw1", "en")
    R.run_harvest(read_raw_responses(spark, f"{root}/raw1", keywords), read_ledger(spark, f"{root}/ledger"),
                  f"{root}/ledger", f"{root}/drops", "run1")
    keywords = raw_landing(spark, sf_dir, f"{root}/raw2")
    parts = None  # source by source: each reads its own folders only
    for s in N.SOURCES:
        one = read_raw_responses(spark, f"{root}/raw2", keywords, sources=[s])
        parts = one if parts is None else parts.unionByName(one)
    return R.gated_batch(R.harvest(parts, read_ledger(spark, f"{root}/ledger"), materialize=True)).select(*RAW_COLUMNS)


@register("harvest_replayed", BASE_SQL + AB_SQL + _harvest_ctes("s", "TRUE", None) + "\nSELECT "
          + ", ".join(f"coalesce(cast({c} AS varchar), '') AS {c}" for c in PAPER_COLUMNS) + " FROM s_first")
def harvest_replayed(spark, sf_dir):
    """Responses of four sources arrive broken, are kept (J35), mended in two
    goes and replayed: the drops of the three runs are those of a clean one."""
    root = scratch_path(spark, "replay")
    clean = PF.mixed_payloads(spark, sf_dir, N.SOURCES, broken=False)
    land_payloads(clean, f"{root}/clean")
    clean = read_payloads(spark, f"{root}/clean")
    broken = clean.withColumn("body", F.when(F.col("source") == "arxiv", "").when(
        F.col("source").isin("crossref", "plos", "doaj"), F.left("body", F.lit(9))).otherwise(F.col("body")))
    texts = clean.select("file_path", F.col("body").alias("whole"))
    for run, mends in (("r1", None), ("r2", ["arxiv", "plos"]), ("r3", ["crossref", "doaj"])):
        given = broken
        if mends is not None:  # the others are tried as they are, and fail again
            waiting = pending_letters(spark, f"{root}/letters").join(texts, "file_path")
            given = waiting.withColumn("body", F.when(F.col("source").isin(*mends), F.col("whole")).otherwise(F.col("body")))
        R.run_harvest(given.select(*clean.columns), read_ledger(spark, f"{root}/ledger"), f"{root}/ledger", f"{root}/drops",
                      run, {**R.DEFAULT_CONFIG, "min_new_papers": 1}, f"{root}/letters")
    drops = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{root}/drops")
    return drops.select(*[F.coalesce(c, F.lit("")).alias(c) for c in PAPER_COLUMNS])


CAP_SOURCES = ["crossref", "europepmc", "google_scholar"]
CAP_CONFIG = {"max_results_per_source": 7, "sources": {
    "crossref": {"enabled": True}, "europepmc": {"enabled": True}, "google_scholar": {"enabled": True, "max_results": 5}}}


def _cap_sql() -> str:
    parts = []
    for s in CAP_SOURCES:
        from quire.plans.source_queries import CROSSREF_DATE
        sd = CROSSREF_DATE if s == "crossref" else "cast(NULL AS varchar)"
        parts.append(select_sql(s, src="c_d", extra=f"'{s}' AS src, chunk, item_pos, {sd} AS sort_date, "))
    return BASE_SQL + AB_SQL + """,
c_d AS (SELECT dd.*, row_number() OVER (PARTITION BY chunk ORDER BY doc_id) - 1 AS item_pos FROM dd)
SELECT """ + ", ".join(PAPER_COLUMNS) + """ FROM (SELECT *, row_number() OVER (PARTITION BY src, chunk
  ORDER BY sort_date DESC NULLS LAST, item_pos) AS rn FROM (""" + "\nUNION ALL\n".join(parts) + """))
WHERE rn <= CASE WHEN src = 'google_scholar' THEN 5 ELSE 7 END"""


@register("cap_per_response", _cap_sql())
def cap_per_response(spark, sf_dir):
    """Limits per request (J13): responses of 20 records each, landed run after
    run under 20 keywords, keep their own first 7 (5 of one source); a later
    response of the same keyword has its own allowance."""
    pay = None
    for s in CAP_SOURCES:
        p = PF.payloads(spark, sf_dir, s)
        pay = p if pay is None else pay.unionByName(p)
    return R.capped_rows(pay, CAP_CONFIG).select(*PAPER_COLUMNS)
