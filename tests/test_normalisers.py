"""Each source's field rules on hand-written responses with edge records."""

import datetime as dt
import os

import pytest

from quire.schemas import PAYLOADS
from quire.sources import normalisers as N

HERE = os.path.join(os.path.dirname(__file__), "payloads")
FIELDS = ["url", "paper_number", "title", "authors", "published_date", "doi", "abstract",
          "citation_count", "journal"]


def payloads(spark, source, name=None, status=200):
    with open(os.path.join(HERE, name or f"{source}.{'xml' if source == 'arxiv' else 'json'}"),
              encoding="utf-8") as f:
        body = f.read()
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    return spark.createDataFrame([(source, "kw", 0, ts, status, body, name)], PAYLOADS)


def rows(spark, source, **kw):
    out = N.normalise(payloads(spark, source, **kw), source).orderBy("item_pos").collect()
    return [{k: r[k] for k in FIELDS} for r in out]


def row(url, pn, title, authors, date, doi, abstract, cites, journal):
    return dict(zip(FIELDS, [url, pn, title, authors, date, doi, abstract, cites, journal]))


def test_arxiv(spark):
    got = rows(spark, "arxiv")
    assert got == [
        row("http://arxiv.org/abs/2401.00001v2", "2401.00001v2", "A title  over two lines",
            "Ann One, Bob Two", "2024-01-02", "10.1/abc", "Abstract text.", None, "J. Test 1 (2024)"),
        row("http://arxiv.org/abs/2401.00002v1", "2401.00002v1", "No doi", "Cy", "2024-01-03",
            "", "s", None, ""),
    ]


def test_semantic_scholar(spark):
    got = rows(spark, "semantic_scholar")
    assert got == [
        row("https://s/p1", "p1", "T1", "A, B", "2023", "10.2/x", "", 7, "J Alt"),
        row("", "p2", "", "", "None", "", "", None, "Venue"),
        row("", "p3", "no year key", "", "", "", "", None, ""),
    ]
    assert rows(spark, "semantic_scholar", name="semantic_scholar_no_data.json") == []
    st = N.task_status(payloads(spark, "semantic_scholar", name="semantic_scholar_no_data.json"),
                       ["semantic_scholar"]).first()
    assert st.ok is False
    # an HTTP error status fails the task for the sources that check it
    bad = N.task_status(payloads(spark, "semantic_scholar", status=429), ["semantic_scholar"]).first()
    assert bad.ok is False


def test_openalex(spark):
    got = rows(spark, "openalex")
    assert got[0] == row("https://openalex.org/W11", "W11", "OA", "X, Y", "2024-05-06", "10.3/z",
                         "the cat sat", 4, "Src")
    assert got[1] == row("https://openalex.org/W12", "W12", "No index", "", "", "", "", None, "")
    assert got[2]["paper_number"] == ""  # kept by the source, dropped by the blank-key rule


def test_crossref(spark):
    assert rows(spark, "crossref") == [
        row("https://doi.org/10.4/a", "10.4/a", "CR title", "Lee, ", "2021-3-5", "10.4/a",
            "Some text", 9, "Journal CR"),
        row("", "10.4/b", "", "", "2020-11", "10.4/b", "", None, ""),
        row("", "10.4/c", "", "", "2019", "10.4/c", "", None, ""),
    ]


def test_europepmc_core(spark):
    assert rows(spark, "europepmc") == [
        row("https://europepmc.org/article/MED/123", "123", "EP", "Doe J, Roe R.", "2022-07-01", "",
            "abs", 3, "JE")]
    assert rows(spark, "core") == [
        row("https://core/987.pdf", "987", "Core", "Q", "2020-02-03", "10.5/q", "a", None, "JC"),
        row("", "988", "", "", "", "", "", None, ""),
    ]


def test_base(spark):
    assert rows(spark, "base") == [
        row("https://b/1", "oai:x:1", "List title", "A, B", "2018", "10.6/b1", "first", None, "Pub Co"),
        row("https://b/2", "oai:x:2", "Str title", "Solo", "2017", "", "desc", None, "Journal B"),
        row("", "10.6/b3", "T3", "", "", "10.6/b3", "", None, ""),
    ]
    assert rows(spark, "base", name="base_empty.json") == []
    assert N.task_status(payloads(spark, "base", name="base_empty.json"), ["base"]).first().ok


def test_ieee_google(spark):
    assert rows(spark, "ieee_xplore") == [
        row("https://ieee/pdf/555", "555", "IE", "F N", "12 March 2021", "10.7/i", "x", 2, "Trans"),
        row("https://ieee/doc/556", "556", "No pdf", "", "2020", "", "", None, ""),
        row("", "557", "", "", "", "", "", None, ""),
    ]
    g = rows(spark, "google_scholar")
    assert [(r["url"], r["title"], r["authors"], r["published_date"], r["journal"], r["citation_count"])
            for r in g] == [("https://gs/1", "GS one", "A and B", "2019", "V", 11),
                            ("", "GS no url", "", "", "Jonly", 0)]
    import hashlib
    for r, key in zip(g, ["https://gs/1", "GS no url"]):
        assert r["paper_number"] == str(int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % 10 ** 15)


def test_plos_doaj(spark):
    assert rows(spark, "plos") == [
        row("https://journals.plos.org/plosone/article?id=10.1371/journal.pone.1",
            "10.1371/journal.pone.1", "P1", "A, B", "2020-01-02", "10.1371/journal.pone.1",
            "First part", None, "PLOS ONE"),
        row("https://journals.plos.org/plosone/article?id=10.1371/journal.pone.2",
            "10.1371/journal.pone.2", "P2", "", "2021-02-03", "10.1371/journal.pone.2", "Plain",
            None, ""),
        row("https://journals.plos.org/plosone/article?id=10.1371/journal.pone.3",
            "10.1371/journal.pone.3", "P3", "", "", "10.1371/journal.pone.3", "", None, ""),
    ]
    assert rows(spark, "doaj") == [
        row("https://doaj/d1", "d1", "DJ", "N1", "2016", "10.8/d", "ab", None, "JD"),
        row("", "d2", "No link", "", "", "", "", None, ""),
    ]


@pytest.mark.parametrize("source", ["arxiv", "openalex", "crossref"])
def test_unparsable_body_is_a_task_error(spark, source):
    df = payloads(spark, source).selectExpr("source", "keyword", "keyword_idx", "fetched_at",
                                            "status_code", "left(body, 12) AS body", "file_path")
    assert N.normalise(df, source).count() == 0
    assert N.task_status(df, [source]).first().ok is False


def body_rows(spark, source, body):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    pay = spark.createDataFrame([(source, "kw", 0, ts, 200, body, None)], PAYLOADS)
    assert N.task_status(pay, [source]).first().ok
    return N.normalise(pay, source).orderBy("item_pos").collect()


@pytest.mark.parametrize("source, body, field", [
    ("semantic_scholar", '{"data":[{"paperId":"a","citationCount":"7"},{"paperId":"b","citationCount":3}]}', [7, 3]),
    ("openalex", '{"results":[{"id":"x/a","cited_by_count":3000000000},{"id":"x/b","cited_by_count":1}]}', [None, 1]),
    ("crossref", '{"message":{"items":[{"DOI":"a","is-referenced-by-count":"7"},'
                 '{"DOI":"b","is-referenced-by-count":{"n":1}}]}}', [7, None]),
    ("europepmc", '{"resultList":{"result":[{"id":"a","citedByCount":"7"},{"id":"b","citedByCount":2}]}}', [7, 2]),
    ("ieee_xplore", '{"articles":[{"article_number":"a","citing_paper_count":"7"},'
                    '{"article_number":"b","citing_paper_count":null}]}', [7, None]),
    ("google_scholar", '[{"pub_url":"a","num_citations":"7"},{"pub_url":"b","num_citations":1.5}]', [7, None])])
def test_counts_of_any_kind_keep_their_record(spark, source, body, field):
    assert [r.citation_count for r in body_rows(spark, source, body)] == field


def test_a_mistyped_field_costs_only_itself(spark):
    got = body_rows(spark, "crossref", '{"message":{"items":[{"DOI":"a","title":"plain","author":"x"},'
                                       '{"DOI":"b","title":["T"],"author":[{"family":"F"}]}]}}')
    assert [(r.paper_number, r.title, r.authors) for r in got] == [("a", "", ""), ("b", "T", "F")]
    got = body_rows(spark, "doaj", '{"results":[{"id":"a","bibjson":{"title":"A","identifier":["x",'
                                   '{"type":"DOI","id":"10.1/a"}]}},{"id":"b","bibjson":{"title":"B"}}]}')
    assert [(r.paper_number, r.title, r.doi) for r in got] == [("a", "A", "10.1/a"), ("b", "B", "")]
    got = body_rows(spark, "plos", '{"response":{"docs":[{"id":"a","author_display":"Al"},'
                                   '{"id":"b","author_display":["X","Y"]}]}}')
    assert [(r.paper_number, r.authors) for r in got] == [("a", "A, l"), ("b", "X, Y")]


def test_a_response_is_parsed_once(spark):
    """No filter below the generator repeats the parser (it took most of the time)."""
    from quire.plans import payload_fixtures as PF
    rows = N.normalise(PF.payloads(spark, "/root/testdata/sf0.001", "openalex"), "openalex")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("sort_array") == 1
