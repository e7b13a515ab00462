"""Listing response shape, lookups and seq parsing."""

import pytest

from conftest import SMOKE
from quire.operators import query as Q
from quire.plans.fixtures import papers_fx


def test_fetch_page_shape(spark):
    p = papers_fx(spark, SMOKE)
    page = Q.fetch_page(p, skip=0, take=5, keyword="kw1")
    assert len(page["data"]) == 5 and page["totalCount"] > 5
    assert set(page["data"][0]) == {"seq", "url", "site_name", "keyword", "paper_number", "title",
                                    "authors", "published_date", "journal"}
    assert all(len(r["authors"]) <= 300 for r in page["data"])
    assert Q.fetch_page(p, skip=10 ** 6) == {"data": [], "totalCount": 0}


def test_lookup(spark):
    p = papers_fx(spark, SMOKE)
    assert Q.get_paper(p, "17abc")["seq"] == 17       # leading digits, as parseInt does
    with pytest.raises(ValueError):
        Q.get_paper(p, "abc")
    with pytest.raises(LookupError):
        Q.get_paper(p, 10 ** 9)


def test_stats_on_empty_log(spark):
    from quire.schemas import LOAD_LOG
    r = Q.load_stats(spark.createDataFrame([], LOAD_LOG)).first()
    assert (r.total, r.success, r.failed, r.loaded_rows) == (0, 0, 0, 0)


def test_ensure_tables_idempotent(spark, scratch):
    import os
    from quire.sources.tables import ensure_tables, read_load_log, read_papers
    t, lg = os.path.join(scratch, "p"), os.path.join(scratch, "l")
    ensure_tables(spark, t, lg)
    ensure_tables(spark, t, lg)
    assert read_papers(spark, t).count() == 0 and read_load_log(spark, lg).count() == 0


def _stored(spark, scratch, n=90):
    from pyspark.sql import functions as F

    from quire.schemas import PAPER_STORED
    from quire.sources.sinks import append_papers
    kw = F.element_at(F.array(*map(F.lit, ["Alpha%one", "ÉCOLE_two", "ab", "", "naïve three", "x\\y", None])),
                                   (F.col("id") % 7 + 1).cast("int"))
    rows = spark.range(1, n + 1).select(
        F.col("id").alias("seq"), *[(kw if f.name == "keyword" else F.concat(F.lit("Site"), F.col("id") % 5) if f.name == "site_name"
                                     else F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 9)) if f.name == "title"
                                     else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAPER_STORED.fields[1:-1]],
        F.lit("2024-01-01").cast("timestamp_ntz").alias("loaded_at"), F.concat(F.lit("f"), F.col("id") % 5).alias("file_id"))
    path = f"{scratch}/papers"
    append_papers(rows, path)
    return path


def test_piece_table_answers_like_ilike(spark, scratch):
    from quire.operators.query import list_papers
    from quire.sources import serving as V
    from quire.sources.tables import read_papers
    path = _stored(spark, scratch)
    V.write_serving(spark, path)
    papers = read_papers(spark, path)
    for kw, site in (("alpha", None), ("ÉCole", "site1"), ("a%o", "SITE_"), ("l_ha%one", "s"), ("ab", "ite2"), (" ", ""),
                     ("naïve", "nowhere"), ("x\\y", None), ("%", "_____"), (None, "Site%3")):
        want = list_papers(papers, keyword=kw, site=site, take=100, sort="title", order="asc").collect()
        got = V.list_by_pieces(spark, path, kw, site, take=100, sort="title", order="asc").collect()
        assert got == want, (kw, site)
    assert V.pattern_pieces(spark, "A%bcd_EF") == ["bcd"] and V.pattern_pieces(spark, "ÀBCD") == ["bcd", "àbc"]
    # one file holds Site3: the others are pruned by their identity
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "true")
    df = V.list_by_pieces(spark, path, None, "Site3")
    df.collect()
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert V.matching_pairs(spark, path, None, "Site3").select("file_id").distinct().count() == 1


def test_pages_by_order_table(spark, scratch):
    from quire.operators.query import list_papers
    from quire.sources import serving as V
    from quire.sources.tables import read_papers
    path = _stored(spark, scratch)
    V.write_order(spark, path, "title", range_rows=8)
    V.write_order(spark, path, "title", range_rows=8)  # built anew
    papers = read_papers(spark, path)
    for order in ("asc", "desc"):
        for skip in (0, 7, 8, 40, 85, 90, 500):
            want = list_papers(papers, skip, 10, sort="title", order=order).collect()
            assert V.page_by_order(spark, path, "title", order, skip, 10).collect() == want
    import pytest
    with pytest.raises(ValueError):
        V.write_order(spark, path, "abstract")
    with pytest.raises(FileNotFoundError):
        V.page_by_order(spark, path, "journal")


def test_sums_of_replaced_files(spark, scratch):
    from pyspark.sql import functions as F

    from quire.operators.query import citations_by_site, distinct_sites
    from quire.sources import serving as V
    from quire.sources.sinks import append_papers
    from quire.sources.tables import read_papers
    path = _stored(spark, scratch)
    V.write_serving(spark, path)
    changed = V.stored_papers(spark, path).where("file_id = 'f2'").withColumns(
        {"citation_count": (F.col("seq") % 6).cast("int"), "site_name": F.lit("new")}).checkpoint()
    append_papers(changed, path)
    V.write_serving(spark, path, ["f2"])
    assert V.sites_from_sums(spark, path).collect() == distinct_sites(read_papers(spark, path)).collect()
    assert V.citations_from_sums(spark, path).collect() == citations_by_site(read_papers(spark, path)).collect()
    assert V.sites_from_sums(spark, f"{scratch}/none").count() == 0


def test_statistics_of_no_runs(spark):
    from quire.operators.query import load_stats
    from quire.schemas import LOAD_LOG
    assert tuple(load_stats(spark.createDataFrame([], LOAD_LOG)).first()) == (0, 0, 0, 0)


def test_segments_hold_the_table(spark, scratch, monkeypatch):
    """Content stays over compactions, reloads and a crash after every step."""
    import pytest

    from quire.sources import segments as G
    from quire.sources.sinks import append_papers
    from quire.sources.tables import read_papers
    path = _stored(spark, scratch)
    want = sorted(map(str, read_papers(spark, path).collect()))

    def same():
        return sorted(map(str, read_papers(spark, path).collect())) == want
    real = spark.createDataFrame

    def no_list(data, schema=None, *a, **k):
        if schema is G.LIVE:
            raise OSError("crash")
        return real(data, schema, *a, **k)
    monkeypatch.setattr(spark, "createDataFrame", no_list)
    with pytest.raises(OSError):
        G.compact_papers(spark, path, segment_rows=20)  # segments without a list
    monkeypatch.undo()
    assert same() and G.live_segments(spark, path) == []
    monkeypatch.setattr(G, "drop_partitions", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        G.compact_papers(spark, path, segment_rows=20)  # a list, and all partitions
    monkeypatch.undo()
    assert same() and len(G.live_segments(spark, path)) >= 4
    assert G.compact_papers(spark, path, segment_rows=20) == 5 and same()
    assert G.compact_papers(spark, path) == 0
    live = G.live_segments(spark, path)
    assert sum(r["n"] for r in live) == 90 and len(live) >= 4
    assert G._names(spark, G._segments(path), "segment") == sorted(r["segment"] for r in live)
    # a lookup opens the one segment that can hold the row
    one = G.read_stored(spark, path, 33)
    assert len(one.inputFiles()) == 1 and G.stored_paper_by_seq(spark, path, 33).first()["seq"] == 33
    assert G.stored_paper_by_seq(spark, path, 5000).count() == 0
    # an old identity loaded again, with fewer rows, hides what segments hold of it
    rows = G.read_stored(spark, path).where("file_id = 'f3' and seq < 50").checkpoint()
    append_papers(rows, path)
    left = {r["seq"] for r in G.read_stored(spark, path).collect()}
    assert left == {i for i in range(1, 91) if i % 5 != 3 or i < 50}
    assert G.compact_papers(spark, path, segment_rows=20) == 1
    assert {r["seq"] for r in G.read_stored(spark, path).collect()} == left
    assert read_papers(spark, path).count() == len(left)


def test_ranges_stay_few_over_a_large_table(spark, scratch, monkeypatch):
    """Small ranges asked of a large table: few folders, the same rows and pages."""
    import os

    from quire.operators.query import list_papers
    from quire.sources import segments as G
    from quire.sources import serving as V
    from quire.sources.tables import read_papers
    assert [G.range_count(n, 64, 1000) for n in (0, 64, 65, 64 * 256, 10 ** 5, 10 ** 6)] == [1, 1, 2, 256, 256, 1000]
    monkeypatch.setattr(G, "MOST_RANGES", 6)
    path = _stored(spark, scratch)
    want = sorted(map(str, read_papers(spark, path).collect()))
    assert G.compact_papers(spark, path, segment_rows=2) == 5
    assert sorted(map(str, read_papers(spark, path).collect())) == want
    assert 3 <= len(G.live_segments(spark, path)) <= 6
    V.write_order(spark, path, "title", range_rows=2)
    assert 3 <= sum(n.startswith("part=") for n in os.listdir(f"{path}_order/title/keys")) <= 6
    papers = read_papers(spark, path)
    for order, skip in (("asc", 0), ("desc", 41), ("asc", 85)):
        assert V.page_by_order(spark, path, "title", order, skip, 10).collect() \
            == list_papers(papers, skip, 10, sort="title", order=order).collect()
