"""Streaming specifics: raw response files, the gate's pending hand-over."""

import os
import shutil

from pyspark.sql import functions as F

from conftest import SMOKE
from quire.plans import payload_fixtures as PF
from quire.plans.harvest_run import DEFAULT_CONFIG
from quire.sources import normalisers as N
from quire.sources.payloads import read_raw_responses
from quire.streaming.harvest_stream import harvest_stream

HERE = os.path.join(os.path.dirname(__file__), "payloads")


def test_raw_response_files(spark, scratch):
    for src, name, idx in [("crossref", "crossref.json", 0), ("doaj", "doaj.json", 1),
                           ("arxiv", "arxiv.xml", 1)]:
        d = os.path.join(scratch, f"source={src}", f"keyword_idx={idx}")
        os.makedirs(d, exist_ok=True)
        shutil.copy(os.path.join(HERE, name), os.path.join(d, name))
    pay = read_raw_responses(spark, scratch, ["first keyword", "second keyword"])
    got = N.normalise_all(pay).groupBy("site_name", "keyword").count().collect()
    assert {(r.site_name, r.keyword, r["count"]) for r in got} == {
        ("CrossRef", "first keyword", 3), ("DOAJ", "second keyword", 2), ("arXiv", "second keyword", 2)}


def test_responses_of_a_task_share_raw_files(spark, scratch):
    """Many responses land in few files, beside a file of one response; texts,
    repeated and blank ones included, come back one by one, each known by its place."""
    from quire.sources.payloads import land_raw_responses
    bodies = [f'{{"n":{i},\\n"x":"é"}}\n' for i in range(300)] + ["", "same", "same", " \n"]
    rows = [(s, 3, b, code) for s in ("plos", "core") for b in bodies for code in (200, None)] + [("plos", 3, "gone", 404)]
    pay = spark.createDataFrame(rows, "source string, keyword_idx int, body string, status_code int")
    land_raw_responses(pay.repartition(16), scratch)
    land_raw_responses(pay.where("source = 'core'").limit(1), scratch)
    names = [os.path.join(d, n) for d, _, ns in os.walk(scratch) for n in ns if n.startswith("part-")]
    assert len(names) < 20  # 1217 responses
    alone = os.path.join(scratch, "source=plos", "keyword_idx=3", "one.json")
    shutil.copy(os.path.join(HERE, "plos.json"), alone)
    got = read_raw_responses(spark, scratch, [], sources=["plos"]).collect()
    assert sorted(r.body for r in got if not r.file_path.endswith("one.json")) == sorted(2 * bodies)
    assert [r.body for r in got if r.file_path.endswith("one.json")] == [open(alone, encoding="utf-8").read()]
    assert len({r.file_path for r in got}) == len(got) == 609 and {r.source for r in got} == {"plos"}
    assert read_raw_responses(spark, scratch, []).count() == 609 + 609
    assert read_raw_responses(spark, scratch, [], sources=["doaj"]).count() == 0


def test_gate_holds_then_releases(spark, scratch):
    landing = os.path.join(scratch, "landing")
    pay = PF.mixed_payloads(spark, SMOKE, N.SOURCES, broken=False)
    # batch 1: one keyword's responses; batch 2: everything else
    first_kw = pay.where(F.col("keyword_idx") == 0)
    first_kw.coalesce(1).write.parquet(landing + "/a")
    n_first = N.normalise_all(first_kw).select("site_name", "paper_number").distinct().count()
    cfg = dict(DEFAULT_CONFIG, min_new_papers=n_first + 1)
    ck, drops, ledger = (os.path.join(scratch, x) for x in ("ck", "drops", "ledger"))
    pending = os.path.join(scratch, "pending")
    harvest_stream(spark, landing + "/*", ledger, drops, pending, ck, config=cfg, max_files_per_trigger=1)
    assert not os.path.exists(drops)                       # held back by the gate
    assert spark.read.parquet(pending).count() > 0         # responses kept for later
    pay.where(F.col("keyword_idx") != 0).coalesce(1).write.parquet(landing + "/b")
    harvest_stream(spark, landing + "/*", ledger, drops, pending, ck, config=cfg, max_files_per_trigger=1)
    written = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(drops)
    keys = written.select("site_name", "paper_number")
    # the held papers were written with the next batch, none lost, none twice
    assert keys.count() == keys.distinct().count()
    all_keys = N.normalise_all(pay).where(F.length("paper_number") > 0) \
        .select("site_name", "paper_number").distinct()
    assert keys.distinct().count() == all_keys.count() - all_keys.subtract(keys).count()
    assert all_keys.subtract(keys).count() == 0
    assert spark.read.parquet(pending).count() == 0


def test_first_arrivals_do_not_depend_on_the_batches(spark, scratch):
    """Late rows that come first in the order win, ties and empty order values
    included, however the rows are cut into micro-batches."""
    from pyspark.sql import functions as F

    from quire.operators.dedup import dedup_first
    from quire.streaming.dedup_stream import first_arrivals, read_first_arrivals
    rows = [("a", 3, "x"), ("a", 1, "y"), ("b", None, "n"), ("b", 7, "z"), ("a", 2, "w"), (None, 5, "q"), (None, 4, "p"), ("c", None, "o")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    want = {tuple(r) for r in dedup_first(df, ["k"], [F.coalesce("o", F.lit(1 << 62))]).collect()}
    for n, split in enumerate(([8], [1] * 8, [3, 5])):
        root, at = f"{scratch}/{n}", 0
        for size in split:
            spark.createDataFrame(rows[at:at + size], df.schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            at += size
            stream = spark.readStream.schema(df.schema).parquet(f"{root}/in")
            first_arrivals(stream, ["k"], ["o"], f"{root}/out", f"{root}/ckpt")
        got = read_first_arrivals(spark, f"{root}/out", df.schema, ["k"], [F.coalesce("o", F.lit(1 << 62))])
        assert {tuple(r) for r in got.collect()} == want
    assert read_first_arrivals(spark, f"{scratch}/none", df.schema, ["k"], ["o"]).count() == 0


def test_first_updates_run_without_python(spark, scratch):
    """The key state is Spark's own: no key is handed to a Python worker."""
    from quire.streaming.dedup_stream import first_updates
    schema = "k string, o timestamp_ntz, v map<string,int>"
    spark.createDataFrame([], schema).write.parquet(f"{scratch}/in")
    out = first_updates(spark.readStream.schema(schema).parquet(f"{scratch}/in"), ["k"], ["o"])
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan and out.columns == ["k", "o", "v"]
