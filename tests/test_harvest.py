"""A harvest run with real writes: drop + ledger, repeat, gate."""

import os

from pyspark.sql import functions as F

from quire.plans import payload_fixtures as PF
from quire.plans.harvest_run import DEFAULT_CONFIG, harvest, run_harvest
from quire.sources import normalisers as N
from quire.sources.ledger import read_ledger
from conftest import SMOKE


def test_run_then_repeat_finds_nothing_new(spark, scratch):
    pay = PF.mixed_payloads(spark, SMOKE, N.SOURCES).checkpoint()
    ledger_path, drops = os.path.join(scratch, "ledger"), os.path.join(scratch, "drops")
    path, summary = run_harvest(pay, read_ledger(spark, ledger_path), ledger_path, drops, "b1")
    written = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    n = written.count()
    assert n > 0
    assert written.select("site_name", "paper_number").distinct().count() == n  # no key twice
    assert read_ledger(spark, ledger_path).count() == n
    s = {r.source: r for r in summary.collect()}
    assert set(s) == set(N.SOURCES) and sum(r.new_papers for r in s.values()) == n
    assert sum(r.errors for r in s.values()) > 0   # some landed bodies are cut short
    again = harvest(pay, read_ledger(spark, ledger_path))
    assert again.candidates.count() == 0


def test_gate_holds_small_batches(spark):
    pay = PF.mixed_payloads(spark, SMOKE, N.SOURCES)
    cfg = dict(DEFAULT_CONFIG, min_new_papers=10 ** 6)
    res = harvest(pay, read_ledger(spark, None), cfg)
    assert res.new_papers.count() == 0 and res.candidates.count() > 0


def test_caps_per_response(spark):
    from quire.plans.harvest_run import capped_rows
    pay = PF.payloads(spark, "/root/testdata/sf0.01", "crossref")
    cfg = {"max_results_per_source": 4, "sources": {"crossref": {"enabled": True}}}
    rows = capped_rows(pay, cfg)
    responses = pay.count()
    per = [r["count"] for r in rows.groupBy("keyword", "extracted_at").count().collect()]
    assert len(per) == responses and set(per) == {4}      # 20 keywords, each with several responses
    # three responses of one task keep their own records
    three = pay.orderBy("fetched_at").limit(3).withColumns({"keyword": F.lit("k"), "keyword_idx": F.lit(0)})
    assert capped_rows(three).count() == N.normalise(three, "crossref").count()


def test_batch_id_follows_the_responses(spark):
    from quire.plans.harvest_run import responses_id
    pay = PF.payloads(spark, SMOKE, "core")
    assert responses_id(pay) == responses_id(pay.repartition(3)) != responses_id(pay.limit(1))
    assert responses_id(pay.limit(0)) == responses_id(pay.limit(0))


def test_source_limits_and_grid(spark):
    from quire.operators.harvest import source_limits, task_grid
    cfg = {"max_results_per_source": 150, "sources": {
        "arxiv": {"enabled": True}, "semantic_scholar": {"enabled": True},
        "google_scholar": {"enabled": True, "max_results": 50}, "plos": {"enabled": False},
        "nowhere": {"enabled": True}}}
    lim = source_limits(cfg, N.SOURCES)
    assert lim == {"arxiv": 150, "semantic_scholar": 100, "google_scholar": 10}
    kw = spark.createDataFrame([("a", 0), ("b", 1)], "keyword string, keyword_idx int")
    grid = task_grid(kw, cfg, N.SOURCES).collect()
    assert len(grid) == 6 and {r.source for r in grid} == set(lim)
    assert {(r.source, r.limit) for r in grid} == set(lim.items())


def test_ledger_in_buckets(spark, scratch):
    from pyspark.sql import functions as F

    from quire.sources.ledger import append_ledger, compact_ledger, ledger_buckets, ledger_table
    path = f"{scratch}/the ledger"
    keys = spark.range(40).select(F.when(F.col("id") % 9 == 0, "").otherwise(F.lit("hot")).alias("site_name"),
                                  F.col("id").cast("string").alias("paper_number"), F.lit("t").alias("extracted_at"))
    assert read_ledger(spark, path).count() == 0
    append_ledger(keys.where("paper_number < '3'"), path, "a", buckets=3)
    append_ledger(keys, path, "b's")
    append_ledger(keys, path, "b's")  # a repeated run replaces itself
    assert ledger_buckets(spark, path) == 3
    want = {(r.site_name, r.paper_number) for r in keys.where("site_name <> ''").collect()}
    got = [tuple(r) for r in read_ledger(spark, path).collect()]
    assert set(got) == want and len(got) > len(want)
    compact_ledger(spark, path)
    assert sorted(map(tuple, read_ledger(spark, path).collect())) == sorted(want)
    assert spark.sql(f"SHOW PARTITIONS {ledger_table(spark, path)}").count() == 1
    compact_ledger(spark, path)  # one partition: nothing to do
    append_ledger(keys.limit(1).withColumn("paper_number", F.lit("new")).withColumn("site_name", F.lit("s")), path, "c")
    assert ("s", "new") in {tuple(r) for r in read_ledger(spark, path).collect()}


def test_compaction_after_a_crash(spark, scratch, monkeypatch):
    """Old partitions that were not removed only repeat keys."""
    from pyspark.sql import functions as F

    import quire.sources.ledger as L
    path = f"{scratch}/ledger"
    keys = spark.range(20).select(F.lit("s").alias("site_name"), F.col("id").cast("string").alias("paper_number"),
                                  F.lit("t").alias("extracted_at"))
    L.append_ledger(keys.where("paper_number < 5"), path, "a", buckets=2)
    L.append_ledger(keys.where("paper_number >= 4"), path, "b")
    real = L.file_system

    def crash(s, p):
        if "batch_id=" in p:
            raise OSError("gone")
        return real(s, p)
    monkeypatch.setattr(L, "file_system", crash)
    try:
        L.compact_ledger(spark, path)
    except OSError:
        pass
    monkeypatch.undo()
    assert {r.paper_number for r in L.read_ledger(spark, path).collect()} == {str(i) for i in range(20)}
    L.compact_ledger(spark, path)
    assert sorted(int(r.paper_number) for r in L.read_ledger(spark, path).collect()) == list(range(20))


def test_failed_responses_wait_until_they_are_read(spark, scratch):
    import datetime as dt

    from quire.schemas import PAYLOADS
    from quire.sources.dead_letters import pending_letters, read_letters, settle
    at, path = dt.datetime(2024, 1, 1), f"{scratch}/letters"

    def given(*rows):
        return spark.createDataFrame([(s, "kw", 1, at, code, body, f) for s, code, body, f in rows], PAYLOADS)
    first = given(("crossref", 200, "{", "a"), ("crossref", 500, "{}", "b"), ("core", 500, '{"results": []}', "c"),
                  ("semantic_scholar", 200, '{"x": 1}', "d"), ("arxiv", 200, "  ", "e"), ("plos", 200, None, "f"),
                  ("google_scholar", 200, "x", "g"), ("doaj", 200, '{"results": []}', "h"))
    settle(first, path, "r1")
    settle(first, path, "r1")  # a repeated run replaces itself
    waiting = {r.file_path: (r.reason, r.attempt) for r in pending_letters(spark, path).collect()}
    from quire.sources.normalisers import STATUS_CHECKED
    assert waiting["a"] == ("unreadable body", 1) and waiting["d"] == ("no record list", 1)
    assert waiting["e"] == waiting["f"] == ("blank body", 1) and "g" not in waiting and "h" not in waiting
    for f, s in (("b", "crossref"), ("c", "core")):
        assert waiting.get(f) == (("status 500", 1) if s in STATUS_CHECKED else None)
    settle(given(("crossref", 200, '{"message": {"items": []}}', "a"), ("arxiv", 200, "", "e"),
                 ("doaj", 200, '{"results": []}', "new")), path, "r2")
    waiting = {r.file_path: r.attempt for r in pending_letters(spark, path).collect()}
    assert "a" not in waiting and waiting["e"] == 2 and "new" not in waiting and waiting["d"] == 1
    assert pending_letters(spark, path, most_attempts=2).where("file_path = 'e'").count() == 0
    assert read_letters(spark, path).where("run_id = 'r2'").count() == 2
    assert pending_letters(spark, f"{scratch}/none").count() == 0
