"""Source responses -> one normalised paper row per record (PAPER_RAW).

Each landed response is one row of the payload table. A source's body is
parsed with ``from_json``/``from_xml`` against a declared schema (fields that
are "string or list", "number or text" or "absent versus null" are read as
VARIANT). A field of another kind than declared is NULL in its own record;
the record and its response stay. Records are exploded with their position, and the paper columns are plain column
expressions. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.dates import parse_int
from quire.functions.inverted import text_from_inverted_index
from quire.functions.text import (
    first_doi, first_nonempty, join_names, last_segment, left_chars, nz, py_strip,
    remove_all, strip_markup, variant_first_text, variant_text, variant_texts,
)
from quire.schemas import PAPER_COLUMNS, PAYLOADS

# Source registry keys, in registry order, and their site names.
SITE_NAMES = {
    "arxiv": "arXiv",
    "semantic_scholar": "Semantic Scholar",
    "openalex": "OpenAlex",
    "crossref": "CrossRef",
    "europepmc": "Europe PMC",
    "core": "CORE",
    "base": "BASE",
    "ieee_xplore": "IEEE Xplore",
    "google_scholar": "Google Scholar",
    "plos": "PLOS",
    "doaj": "DOAJ",
}
SOURCES = list(SITE_NAMES)
# Sources whose service orders results by a date, newest first.
DATE_ORDERED = {"arxiv", "openalex", "crossref"}
# Sources that reject an HTTP error status before parsing.
STATUS_CHECKED = {"arxiv", "semantic_scholar", "base"}
# URL templates and markers used by the sources.
EUROPEPMC_URL = "https://europepmc.org/article/"
PLOS_URL = "https://journals.plos.org/plosone/article?id="
DOI_PREFIX = "https://doi.org/"
ARXIV_ID_MARKER = "/abs/"
# Google Scholar keys: the landed records carry no id, so the key is a stable
# hash of url-or-title (first 13 hex digits of its MD5, modulo 10^15), the
# same in every run (the service-side id is not in the response).
GS_KEY_MODULUS = 10 ** 15

_NAME = "array<struct<name:string>>"

SCHEMAS = {
    "arxiv": ("entry array<struct<id:string, title:string, author:" + _NAME + ", "
              "published:string, summary:string, `arxiv:doi`:string, "
              "`arxiv:journal_ref`:string>>, _corrupt_record string"),
    "semantic_scholar": (
        "data array<struct<paperId:string, url:string, title:string, authors:" + _NAME + ", "
        "year:variant, externalIds:struct<DOI:string>, abstract:string, citationCount:variant, "
        "publicationVenue:struct<name:string>, journal:struct<name:string>>>, "
        "_corrupt_record string"),
    "openalex": (
        "results array<struct<id:string, title:string, "
        "authorships:array<struct<author:struct<display_name:string>>>, "
        "publication_date:string, doi:string, "
        "abstract_inverted_index:map<string,array<int>>, cited_by_count:variant, "
        "primary_location:struct<source:struct<display_name:string>>>>, "
        "_corrupt_record string"),
    "crossref": (
        "message struct<items:array<struct<DOI:string, URL:string, title:array<string>, "
        "author:array<struct<family:string>>, "
        "published:struct<`date-parts`:array<array<bigint>>>, abstract:string, "
        "`is-referenced-by-count`:variant, `container-title`:array<string>>>>, "
        "_corrupt_record string"),
    "europepmc": (
        "resultList struct<result:array<struct<id:string, source:string, title:string, "
        "authorString:string, firstPublicationDate:string, doi:string, abstractText:string, "
        "citedByCount:variant, journalTitle:string>>>, _corrupt_record string"),
    "core": (
        "results array<struct<id:variant, downloadUrl:string, title:string, authors:" + _NAME
        + ", publishedDate:string, doi:string, abstract:string, "
        "journals:array<struct<title:string>>>>, _corrupt_record string"),
    "base": (
        "response struct<docs:array<struct<dcidentifier:variant, dctitle:variant, "
        "dccreator:variant, dcsource:variant, dcpublisher:variant, dclink:string, "
        "dcyear:variant, dcdescription:variant>>>, _corrupt_record string"),
    "ieee_xplore": (
        "articles array<struct<article_number:variant, pdf_url:variant, document_link:string, "
        "title:string, authors:struct<authors:array<struct<full_name:string>>>, "
        "publication_date:string, doi:string, abstract:string, citing_paper_count:variant, "
        "publication_title:string>>, _corrupt_record string"),
    "google_scholar": (
        "array<struct<pub_url:string, num_citations:variant, bib:struct<title:string, "
        "author:array<string>, pub_year:variant, doi:string, abstract:string, venue:string, "
        "journal:string>>>"),
    "plos": (
        "response struct<docs:array<struct<id:string, title_display:string, "
        "author_display:variant, publication_date:string, abstract:variant, "
        "journal:string>>>, _corrupt_record string"),
    "doaj": (
        "results array<struct<id:string, bibjson:struct<title:string, author:" + _NAME + ", "
        "year:variant, abstract:string, identifier:array<variant>, "
        "link:array<struct<url:string>>, journal:struct<title:string>>>>, "
        "_corrupt_record string"),
}

# Where the record list sits inside the parsed body.
RECORD_PATHS = {
    "arxiv": "entry", "semantic_scholar": "data", "openalex": "results",
    "crossref": "message.items", "europepmc": "resultList.result", "core": "results",
    "base": "response.docs", "ieee_xplore": "articles", "google_scholar": None,
    "plos": "response.docs", "doaj": "results",
}


def py_str(v: Column) -> Column:
    """Text of an optional JSON value the way Python's str(d.get(k, "")) reads:
    absent -> '', null -> 'None', otherwise the value's text."""
    return (F.when(v.isNull(), F.lit(""))
            .when(F.is_variant_null(v), F.lit("None"))
            .otherwise(nz(variant_text(v))))


def _count(v: Column) -> Column:
    """A count as an integer, also where it comes as text; NULL for anything
    else and for one that does not fit."""
    return parse_int(variant_text(v))


def _names(v: Column) -> Column:
    """Names as Python's ", ".join reads them: of a list its items, of a plain
    text its characters."""
    text = F.concat_ws(", ", F.split(nz(variant_text(v)), ""))
    return F.when(F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False)),
                  join_names(variant_texts(v))).otherwise(text)


def _one_line(c: Column) -> Column:
    return py_strip(F.replace(nz(c), F.lit("\n"), F.lit(" ")))


def _arxiv(r):
    rid = nz(r["id"])
    return dict(
        key=rid, url=rid, paper_number=last_segment(rid, ARXIV_ID_MARKER),
        title=_one_line(r["title"]), authors=join_names(r["author"], "name"),
        published_date=left_chars(nz(r["published"]), 10), doi=py_strip(nz(r["arxiv:doi"])),
        abstract=_one_line(r["summary"]), citation_count=F.lit(None),
        journal=py_strip(nz(r["arxiv:journal_ref"])), sort_date=r["published"])


def _semantic_scholar(r):
    return dict(
        key=nz(r["paperId"]), url=nz(r["url"]), paper_number=nz(r["paperId"]),
        title=nz(r["title"]), authors=join_names(r["authors"], "name"),
        published_date=py_str(r["year"]), doi=nz(r["externalIds"]["DOI"]),
        abstract=nz(r["abstract"]), citation_count=_count(r["citationCount"]),
        journal=first_nonempty(r["publicationVenue"]["name"], r["journal"]["name"]))


def _openalex(r):
    rid = nz(r["id"])
    return dict(
        key=None, url=rid, paper_number=last_segment(rid, "/"), title=nz(r["title"]),
        authors=join_names(F.transform(r["authorships"], lambda a: a["author"]["display_name"])),
        published_date=nz(r["publication_date"]), doi=remove_all(r["doi"], DOI_PREFIX),
        abstract=text_from_inverted_index(r["abstract_inverted_index"]),
        citation_count=_count(r["cited_by_count"]),
        journal=nz(r["primary_location"]["source"]["display_name"]),
        sort_date=r["publication_date"])


def _crossref(r):
    parts = F.coalesce(F.try_element_at(r["published"]["date-parts"], F.lit(1)),
                       F.array().cast("array<bigint>"))
    date = F.array_join(F.transform(parts, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), "-")
    return dict(
        key=nz(r["DOI"]), url=nz(r["URL"]), paper_number=nz(r["DOI"]),
        title=nz(F.try_element_at(r["title"], F.lit(1))), authors=join_names(r["author"], "family"),
        published_date=date, doi=nz(r["DOI"]), abstract=strip_markup(r["abstract"]),
        citation_count=_count(r["is-referenced-by-count"]),
        journal=nz(F.try_element_at(r["container-title"], F.lit(1))), sort_date=date)


def _europepmc(r):
    pid = nz(r["id"])
    return dict(
        key=pid, url=F.concat(F.lit(EUROPEPMC_URL), nz(r["source"]), F.lit("/"), pid),
        paper_number=pid, title=nz(r["title"]), authors=nz(r["authorString"]),
        published_date=nz(r["firstPublicationDate"]), doi=nz(r["doi"]),
        abstract=nz(r["abstractText"]), citation_count=_count(r["citedByCount"]),
        journal=nz(r["journalTitle"]))


def _core(r):
    pid = py_str(r["id"])
    journal = nz(F.try_element_at(r["journals"], F.lit(1))["title"])
    return dict(
        key=pid, url=nz(r["downloadUrl"]), paper_number=pid, title=nz(r["title"]),
        authors=join_names(r["authors"], "name"),
        published_date=left_chars(nz(r["publishedDate"]), 10), doi=nz(r["doi"]),
        abstract=nz(r["abstract"]), citation_count=F.lit(None), journal=journal)


def _base(r):
    creator = r["dccreator"]
    authors = F.when(F.coalesce(F.schema_of_variant(creator).startswith("ARRAY"), F.lit(False)),
                     join_names(variant_texts(creator))).otherwise(nz(variant_text(creator)))
    src = nz(variant_first_text(r["dcsource"]))
    journal = F.when(src.startswith("http"), nz(variant_first_text(r["dcpublisher"]))).otherwise(src)
    return dict(
        key=None, url=nz(r["dclink"]), paper_number=nz(variant_first_text(r["dcidentifier"])),
        title=nz(variant_first_text(r["dctitle"])), authors=authors,
        published_date=py_str(r["dcyear"]), doi=first_doi(variant_texts(r["dcidentifier"])),
        abstract=nz(variant_first_text(r["dcdescription"])), citation_count=F.lit(None),
        journal=journal)


def _ieee_xplore(r):
    an = py_str(r["article_number"])
    pdf = r["pdf_url"]
    url = F.when(pdf.isNull(), nz(r["document_link"])).otherwise(nz(variant_text(pdf)))
    return dict(
        key=an, url=url, paper_number=an, title=nz(r["title"]),
        authors=join_names(r["authors"]["authors"], "full_name"),
        published_date=nz(r["publication_date"]), doi=nz(r["doi"]), abstract=nz(r["abstract"]),
        citation_count=_count(r["citing_paper_count"]), journal=nz(r["publication_title"]))


def _google_scholar(r):
    bib = r["bib"]
    key_text = first_nonempty(r["pub_url"], bib["title"])
    digest = F.conv(F.substring(F.md5(key_text), 1, 13), 16, 10).cast("long")
    number = (digest % F.lit(GS_KEY_MODULUS)).cast("string")
    return dict(
        key=None, url=nz(r["pub_url"]), paper_number=number, title=nz(bib["title"]),
        authors=join_names(bib["author"], sep=" and "), published_date=py_str(bib["pub_year"]),
        doi=nz(bib["doi"]), abstract=nz(bib["abstract"]), citation_count=_count(r["num_citations"]),
        journal=first_nonempty(bib["venue"], bib["journal"]))


def _plos(r):
    pid = nz(r["id"])
    return dict(
        key=pid, url=F.concat(F.lit(PLOS_URL), pid), paper_number=pid,
        title=nz(r["title_display"]), authors=_names(r["author_display"]),
        published_date=left_chars(nz(r["publication_date"]), 10), doi=pid,
        abstract=nz(variant_first_text(r["abstract"])), citation_count=F.lit(None),
        journal=nz(r["journal"]))


def _doaj(r):
    bib = r["bibjson"]
    # identifiers that are no objects are passed over
    doi_ids = F.filter(bib["identifier"],
                       lambda x: F.lower(F.try_variant_get(x, "$.type", "string")) == F.lit("doi"))
    doi = F.try_variant_get(F.try_element_at(doi_ids, F.lit(1)), "$.id", "string")
    return dict(
        key=nz(r["id"]), url=nz(F.try_element_at(bib["link"], F.lit(1))["url"]),
        paper_number=nz(r["id"]), title=nz(bib["title"]), authors=join_names(bib["author"], "name"),
        published_date=py_str(bib["year"]), doi=nz(doi),
        abstract=nz(bib["abstract"]), citation_count=F.lit(None), journal=nz(bib["journal"]["title"]))


RULES: dict[str, Callable[[Column], dict]] = {
    "arxiv": _arxiv, "semantic_scholar": _semantic_scholar, "openalex": _openalex,
    "crossref": _crossref, "europepmc": _europepmc, "core": _core, "base": _base,
    "ieee_xplore": _ieee_xplore, "google_scholar": _google_scholar, "plos": _plos,
    "doaj": _doaj,
}


def _parse_expr(source: str) -> Column:
    opts = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
    if source == "arxiv":
        opts.update(rowTag="feed", ignoreSurroundingSpaces="false")
        return F.from_xml(F.col("body"), SCHEMAS[source], opts)
    return F.from_json(F.col("body"), SCHEMAS[source], opts)


def _records(source: str, p: Column) -> Column:
    path = RECORD_PATHS[source]
    if path is None:
        return p
    c = p
    for part in path.split("."):
        c = c[part]
    return c


def _ok(source: str, p: Column) -> Column:
    """Task success: body parses; for some sources also an OK status, and one
    source treats a missing record list as an error."""
    if source == "google_scholar":  # the client's errors end the list, never the task
        return F.lit(True)
    ok = F.coalesce(F.col("body").rlike(r"\S"), F.lit(False))
    # a field of an unexpected kind is NULL in its record and marks the body as
    # corrupt too; only a body that is no JSON (or XML) at all fails the task
    parsed = p["_corrupt_record"].isNull()
    if source != "arxiv":
        parsed = parsed | F.try_parse_json(F.col("body")).isNotNull()
    ok = ok & p.isNotNull() & parsed
    if source in STATUS_CHECKED:
        ok = ok & (F.coalesce(F.col("status_code"), F.lit(200)) < 400)
    if source == "semantic_scholar":
        ok = ok & p["data"].isNotNull()
    return F.coalesce(ok, F.lit(False))


def _paper_struct(source: str, r: Column, i: Column) -> Column:
    """One record -> the uniform paper struct (same type for every source)."""
    spec = RULES[source](r)
    fields = []
    for c in PAPER_COLUMNS:
        if c in ("site_name", "keyword", "extracted_at"):
            continue
        e = spec[c]
        fields.append((e.cast("int") if c == "citation_count" else e.cast("string")).alias(c))
    key = spec.get("key")
    sort_date = spec.get("sort_date") if source in DATE_ORDERED else None
    fields += [
        i.cast("int").alias("item_pos"),
        (F.lit(None) if sort_date is None else sort_date).cast("string").alias("sort_date"),
        # records of sources that skip a blank id carry keep = false
        (F.lit(True) if key is None else F.length(key) > 0).alias("keep"),
    ]
    return F.struct(*fields)


def _record_fn(source: str):
    return lambda r, i: _paper_struct(source, r, i)


def parse_payloads(payloads: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """One row per response, parsed once: ``source, keyword, keyword_idx,
    fetched_at, ok, papers`` where ``papers`` is the array of normalised
    records. Responses of all sources go through one projection; each row
    only evaluates its own source's parser (CASE on ``source``)."""
    parse_cols, ok, papers = _expressions(payloads.sparkSession, tuple(sources or SOURCES))
    parsed = payloads.select(
        "source", "keyword", "keyword_idx", "fetched_at", "status_code", "body", *parse_cols)
    return parsed.select(
        "source", "keyword", F.col("keyword_idx").cast("int").alias("keyword_idx"), "fetched_at",
        ok.alias("ok"), papers.alias("papers"))


_EXPR_CACHE: dict = {}


def _expressions(spark, sources: tuple[str, ...]):
    """The parse / ok / papers expressions for a source set. They do not
    depend on the DataFrame, so they are built once per session (building
    them costs thousands of JVM calls)."""
    key = (spark.sparkContext.applicationId, sources)
    if key not in _EXPR_CACHE:
        src = F.col("source")
        parse_cols = [F.when(src == F.lit(s), _parse_expr(s)).alias(f"_p_{s}") for s in sources]
        ok = F.lit(False)
        papers = F.lit(None)
        for s in reversed(sources):
            p = F.col(f"_p_{s}")
            arr = F.transform(_records(s, p), _record_fn(s))
            ok = F.when(src == F.lit(s), _ok(s, p)).otherwise(ok)
            papers = F.when(src == F.lit(s), arr).otherwise(papers)
        _EXPR_CACHE[key] = (parse_cols, ok, papers)
    return _EXPR_CACHE[key]


def rows_of(parsed: DataFrame) -> DataFrame:
    """Paper rows (PAPER_RAW + ``source, keyword_idx, item_pos, sort_date``)
    of the successful responses; records without a required id are skipped."""
    site = F.element_at(F.create_map(*[x for k, v in SITE_NAMES.items()
                                       for x in (F.lit(k), F.lit(v))]), F.col("source"))
    # one generator that no condition on its input precedes: a filter would be
    # pushed below the parser, and every response parsed again for it
    rows = (parsed.select("source", "keyword", "keyword_idx", "fetched_at",
                          F.explode_outer(F.when(F.col("ok"), F.col("papers"))).alias("r"))
            .where(F.col("r.keep")))
    cols = []
    for c in PAPER_COLUMNS:
        if c == "site_name":
            cols.append(site.alias(c))
        elif c == "keyword":
            cols.append(F.col("keyword").cast("string").alias(c))
        elif c == "extracted_at":
            cols.append(F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias(c))
        else:
            cols.append(F.col(f"r.{c}").alias(c))
    return rows.select(*cols, "source", "keyword_idx", F.col("r.item_pos").alias("item_pos"),
                       F.col("r.sort_date").alias("sort_date"))


def task_status(payloads: DataFrame, sources: list[str] | None = None,
                parsed: DataFrame | None = None) -> DataFrame:
    """One row per landed response: ``source, keyword, keyword_idx, ok``."""
    parsed = parsed if parsed is not None else parse_payloads(payloads, sources)
    return parsed.select("source", "keyword", "keyword_idx", "ok")


def judge_payloads(payloads: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """PAYLOADS rows of the given sources with ``reason``: why the task of a
    response failed, NULL where it did not. Records are not looked at."""
    chosen = list(sources or SOURCES)
    parse_cols, ok, _ = _expressions(payloads.sparkSession, tuple(chosen))
    code = F.coalesce(F.col("status_code"), F.lit(200))
    listless = F.col("source").isin("semantic_scholar") & F.col("_p_semantic_scholar").isNotNull() \
        if "semantic_scholar" in chosen else F.lit(False)
    reason = (F.when(ok, F.lit(None))
              .when(F.col("source").isin(*STATUS_CHECKED) & (code >= 400), F.concat(F.lit("status "), code))
              .when(~F.coalesce(F.col("body").rlike(r"\S"), F.lit(False)), F.lit("blank body"))
              .when(listless & F.try_parse_json(F.col("body")).isNotNull(), F.lit("no record list"))
              .otherwise(F.lit("unreadable body")))
    names = [f.name for f in PAYLOADS.fields]
    return (payloads.where(F.col("source").isin(*chosen)).select(*names, *parse_cols)
            .select(*names, reason.cast("string").alias("reason")))


def normalise(payloads: DataFrame, source: str) -> DataFrame:
    """PAPER_RAW rows of one source plus task columns ``source, keyword_idx,
    item_pos, sort_date``. Records of a failed task are dropped (task error)."""
    if source not in RULES:
        raise KeyError(f"unknown source {source}")
    return rows_of(parse_payloads(payloads.where(F.col("source") == F.lit(source)), [source]))


def normalise_all(payloads: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Rows of every source in one pass (bag union, no dedup here)."""
    sources = sources or SOURCES
    return rows_of(parse_payloads(payloads.where(F.col("source").isin(*sources)), sources))
