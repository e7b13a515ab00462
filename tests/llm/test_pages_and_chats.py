"""Page, URL and chat operators, the pipeline and the SQL of the queries."""

import hashlib
import html
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import SMOKE
from oracle_check import compare, duck
from quire.llm import queries as Q
from quire.llm import registry
from quire.llm.common import table
from quire.llm.host_paths import extract, extract_pages, vote
from quire.llm.reply_trees import best_branches, chain, format_branches, read_loss, read_turns
from quire.llm.url_filter import judge_urls, mark_listed


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    res = compare(spark, duck(SMOKE), name, E.queries()[name], registry.ORACLES[name], SMOKE)
    assert res["status"] == "match", res


# 4, pages

PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<div class='post post-17'><h2>A &lt;b&gt;\n title</h2><!-- x --><p>One&nbsp;two <b>three<br>four<p>Five &amp six"
        "<ul><li>x<li>y</ul><div class=\"share\">Share</div><form><p>mail</p></form><script>if (a<b) '</p>'</script>"
        "<section class='comments'><p>nice</p></section></div><aside>s</aside><footer><p>&copy; me</p></footer></body>")


def test_extract_main_text():
    assert extract(PAGE, None)[0] == "A <b> title\nOne two three four\nFive & six\nx\ny"
    assert vote(PAGE) == "body>div.post.post-#"
    assert extract(None, ["p"]) == ("", None) and extract("", None) == ("", None)
    assert extract("just text <b>here", None)[0] == "just text here"
    assert extract("<p>cut <a href='x", None)[0] == "cut"
    assert extract("<script>never closed <p>x", None)[0] == ""
    assert extract("<div>" * 30_000 + "deep", None)[0] == "deep"


def test_names_of_wrappers_do_not_empty_the_page():
    art = "<p>" + "The article goes on. " * 20 + "</p>"
    want = " ".join(("The article goes on. " * 20).split())
    for name in ("layout has-sidebar", "no-sidebar", "long-form", "with-comments", "sidebar", "right-sidebar"):
        for page in (f"<div class='{name}'><article>{art}</article></div>", f"<div class='{name}'>{art}</div>",
                     f"<div class='{name}'><main>{art}</main></div><div class='footer'><p>foot</p></div>"):
            assert extract(f"<body>{page}</body>", None)[0] == want, page
    assert extract(f"<body><form id=aspnetForm><div>{art}</div></form></body>", None)[0] == want
    for header in ("<header class='entry-header'>", "<header class=header>", "<header>"):
        page = f"<body><article>{header}<h1>Title</h1></header>{art}<div class='share-buttons'>Share</div></article></body>"
        assert extract(page, None)[0] == "Title\n" + want
    assert extract("<body><p><a href=/>Skip</a></p><div class=widget><p>one</p></div><div class=promo><p>two</p></div></body>",
                   None)[0] != ""


def test_names_still_drop_what_is_no_article():
    art = "<p>" + "The article goes on. " * 20 + "</p>"
    want = " ".join(("The article goes on. " * 20).split())
    comments = "<div class=comments>" + "<p>A long opinion of somebody else.</p>" * 50 + "</div>"
    assert extract(f"<body><article>{art}</article>{comments}</body>", None)[0] == want
    for name in ("cookie-notice", "related-posts", "ad", "sidebarLeft", "social_links", "comment-list", "widget-2"):
        assert extract(f"<body><div>{art}<div class='{name}'><p>not this</p></div></div></body>", None)[0] == want, name
    teasers = "<div class=related><article><p>teaser</p></article></div>"
    assert extract(f"<body><article>{art}{teasers}</article></body>", None)[0] == want


def test_titles_and_parts_beside_the_main_container():
    one = " ".join(("The article goes on. " * 20).split())
    art, part = f"<p>{one}</p>", "<p>A shorter part of it stands here.</p>"
    want = "Title\n" + one
    for page in (f"<article><h1>Title</h1><div class='entry-content'>{art}</div></article>",
                 f"<div class=page><h1>Title</h1><div class=content>{art}</div></div>",
                 f"<h1>Title</h1><div class=content>{art}</div>",
                 f"<div class=page><div class='page-title'><h2>Title</h2></div><div class=content>{art}</div></div>"):
        assert extract(f"<body><nav><a href=/>Home</a></nav>{page}<footer>f</footer></body>", None)[0] == want, page
    three = f"<div><div class=lead>{part}</div><div class=body>{art}</div><div class=cont>{part}</div></div>"
    links = "<div class=list><p><a href=/1>one more page</a> <a href=/2>and another</a></p></div>"
    got = extract(f"<body><div class=page>{links}{three}{links}</div></body>", None)[0]
    assert got == f"A shorter part of it stands here.\n{one}\nA shorter part of it stands here."
    # beside the article in the body nothing but a heading is taken
    assert extract(f"<body><h1>Title</h1><p>Some notice.</p><article>{art}</article><p>Legal text.</p></body>", None)[0] == want


@pytest.mark.parametrize("name", "user-comments reader-comments post-comments article-comments author-comments comment-thread "
                         "commentlist related-content sponsored-content cookie-policy page-header promo-card advert-label "
                         "ad-label".split())
def test_telling_words_at_either_end_of_a_name(name):
    one = " ".join(("The article goes on. " * 20).split())
    body = f"<p>{one}</p><div class='{name}'><p>Something else is said here.</p></div><p>End.</p>"
    assert extract(f"<body><article>{body}</article></body>", None)[0] == one + "\nEnd."
    assert extract(f"<body><div class='{name}'><article><p>{one}</p></article></div></body>", None)[0] == one
    assert extract(f"<body><article><p class='no-share has-ads'>{one}</p></article></body>", None)[0] == one
    assert extract(f"<body><article><div class='entry-header'><h1>T</h1></div><p>{one}</p></article></body>", None)[0] == "T\n" + one


def test_deep_containers_keep_their_own_paths():
    a, b = vote("<body>" + "<div class=x>" + "<div>" * 14 + "<p>text</p>"), vote("<body>" + "<div class=y>" + "<div>" * 14 + "<p>text</p>")
    assert a != b and a.split(":")[1] == b.split(":")[1]


def plain_host_paths(rows, share):
    """Votes counted and pages read again with Python dictionaries."""
    votes = {}
    for _, url, page in rows:
        m = re.search(r"://([^/?#]*)", url or "")
        host, path = (m[1].lower() if m else ""), vote(page)
        if path is not None:
            votes.setdefault(host, {}).setdefault(path, 0)
            votes[host][path] += 1
    out = []
    for i, url, page in rows:
        m = re.search(r"://([^/?#]*)", url or "")
        v = votes.get(m[1].lower() if m else "", {})
        paths = [p for p in sorted(v, key=lambda p: (-v[p], p)) if v[p] >= share * sum(v.values())]
        out.append((i, *extract(page, paths)))
    return sorted(out, key=str)


def test_votes_against_brute_force(spark):
    r = random.Random(11)
    words = "the article goes on with some words and then ends here".split()

    def page(i):
        text = lambda n: " ".join(r.choices(words, k=n)) + "."
        main, side = r.choice(["content", "story", "box"]), r.choice(["box", "aux", "story"])
        return (f"<body><div class='{main} p-{i}'><h2>{text(3)}</h2><p>{text(r.randint(1, 40))}</p></div>"
                f"<div class={side}><p>{text(r.randint(1, 30))}</p></div></body>")
    rows = [(i, r.choice(["http://A.com/x", "https://a.com/y?z", "http://b.org", None, "no host"]), r.choice([page(i)] * 9 + [None, ""]))
            for i in range(150)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for share in (.05, .3):
        got = [(x["page_id"], x["text"], x["main_path"]) for x in extract_pages(df, share=share).collect()]
        assert sorted(got, key=str) == plain_host_paths(rows, share)


def test_votes_decide_by_host(spark):
    rows = [(i, f"http://h/{i}", "<body><div class=a><p>" + "long text " * 30 + "</div><div class=b><p>small</div>")
            for i in range(5)]
    rows += [(9, "http://h/9", "<body><div class=a><p>short</div><div class=b><p>" + "comment " * 50 + "</div>"),
             (10, "http://other/1", "<body><div class=b><p>own best</div>"),
             (11, None, None), (12, "no scheme", ""), (9, "http://h/9", "<p>again")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("row", F.lit(1)) \
        .withColumn("Main_Path", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {(r["page_id"], r["text"]) for r in extract_pages(df, share=.3).collect()}
    assert (9, "short") in got and (10, "own best") in got and (11, "") in got and (12, "") in got and (9, "again") in got
    assert extract_pages(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    src = {r["page_id"]: r["html"] for r in table(spark, SMOKE, "pages").collect()}
    for r in Q.op4_host_paths(spark, SMOKE).collect():
        inner = re.search(r"(?s)<article>(.*?)(?:</article>|$)", src[r["page_id"]])[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# 3, chats

def test_best_branch_of_trees(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.5), (1, 3, 1, "assistant", "good", 2.0),
            (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", None, 1.0), (2, 1, None, None, "alone", None),
            (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (4, 7, 99, "user", "orphan", 1.0),
            (None, 1, None, "user", "no tree", 1.0), (5, None, None, "user", "no id", 1.0),
            (2, 1, None, None, "alone", None), (6, 1, 1, "user", "self", 1.0)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    df = df.withColumn("leaf", F.lit("clash")).withColumn("formatted", F.lit("clash"))
    out = format_branches(df, score_col="score")
    got = {r["tree"]: r for r in out.withColumn("turns", read_turns(F.col("formatted")))
           .withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(got) == {1, 2, 4, None}
    assert [t["text"] for t in got[1]["turns"]] == ["q", "good", "more", ""] and got[1]["loss"] == ["good", ""]
    assert got[2]["n_turns"] == 1 and got[2]["turns"][0]["role"] == ""
    both = format_branches(df, score_col="score", best=2).where("tree = 1").orderBy("rank").collect()
    assert [r["leaf"] for r in both] == [5, 2]
    assert format_branches(df.limit(0)).count() == 0


def test_long_chain_and_control_strings(spark):
    odd = ["</turn>\n### user:\n", "\\", "\\b\\l#", "a:b", "", "ü漢🙂\r\n", "</turn>", "### Assistant: x"]
    rows = [(1, i, "assistant" if i % 2 else "us:er\\<#", odd[i % len(odd)]) for i in range(300)]
    df = chain(spark.createDataFrame(rows, "c long, t long, role string, text string"), "c", ["t"])
    r = format_branches(df, tree_col="c").withColumn("turns", read_turns(F.col("formatted"))) \
        .withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans"))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows]
    assert r["loss"] == [x[3] for x in rows if x[2] == "assistant"]


def test_very_long_texts_and_urls(spark):
    long = "</turn> \\ word # " * 60_000
    df = chain(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "x")],
                                     "c long, t long, role string, text string"), "c", ["t"])
    r = format_branches(df, tree_col="c").withColumn("turns", read_turns(F.col("formatted"))) \
        .withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans"))).first()
    assert [t["text"] for t in r["turns"]] == [long, long + "x"] and r["loss"] == [long + "x"]
    url = "http://h.org/" + "p" * 200_000
    pages = spark.createDataFrame([(1, url), (2, url + "q")], "page_id long, url string")
    got = {x["page_id"]: x for x in judge_urls(pages, spark.createDataFrame([(url[7:],)], "k string"), Q.URL_RULES).collect()}
    assert got[1]["verdict"] == "block" and got[2]["verdict"] == "allow" and len(got[2]["path"]) == 200_002
    page = "<body><article>" + "<p>One more sentence stands here.</p>" * 20_000 + "</article></body>"
    assert extract(page, None)[0].count("\n") == 19_999


def test_branches_against_brute_force(spark):
    import random
    rnd = random.Random(4)
    rows = [(t, n, rnd.randrange(n) if n else None, float(rnd.randrange(5))) for t in range(5) for n in range(60)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for r in best_branches(df, 3).orderBy("depth").collect():
        got.setdefault((r["tree"], r["rank"]), []).append(r["node"])
    for t in range(5):
        up = {n: p for tt, n, p, _ in rows if tt == t}
        sc = {n: s for tt, n, _, s in rows if tt == t}
        paths = []
        for n in set(up) - set(up.values()):
            p = [n]
            while up[p[-1]] is not None:
                p.append(up[p[-1]])
            paths.append(p[::-1])
        paths.sort(key=lambda p: (-sum(sc[n] for n in p), -len(p), p[-1]))
        assert [got[t, k + 1] for k in range(3)] == paths[:3]


def test_fixed_conversation(spark):
    said = "\\### Assistant: </turn> ok"
    r = Q.op3_reply_trees(spark, SMOKE).where("conv_id = -7").first()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# 10, URLs

def test_lists_are_exact_in_any_number_of_passes(spark):
    keys = [f"k{i}" for i in range(3000)]
    rows = spark.createDataFrame([(k,) for k in keys + [None, "k1"]], "key string").withColumn("Listed", F.lit(7))
    listed = spark.createDataFrame([(k,) for k in keys[::3] + [None, "k0", "elsewhere"]], "k string")
    for bits in (1 << 27, 4000):
        got = mark_listed(rows, "key", listed, most_bits=bits).collect()
        assert len(got) == len(keys) + 2
        assert all(r["listed"] == (r["key"] in set(keys[::3])) for r in got)
    assert mark_listed(rows, "key", listed.limit(0)).where("listed").count() == 0
    assert mark_listed(rows.limit(0), "key", listed).count() == 0


def test_url_verdicts(spark):
    urls = {"http://a.COM/x": "com/", "https://www.example.com/en/1": "www.example.com/en/",
            "https://m.example.com/en/1": "example.com/en/", "x://a.net/es/": "net/es/", "http://net/fr/": "net/fr/",
            "http://b.com": None, "http://xcom/": None, "nothing": None, None: None, "a://b?c://d.com/": None,
            "http://h.org/p?q#f": None}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string") \
        .withColumn("host", F.lit("clash")).withColumn("listed", F.lit("clash")).withColumn("key", F.lit("clash"))
    listed = spark.createDataFrame([("h.org/p",)], "k string")
    got = {r["url"]: r for r in judge_urls(df, listed, Q.URL_RULES).collect()}
    assert {u: r["rule"] for u, r in got.items()} == urls
    assert got["http://h.org/p?q#f"]["verdict"] == "block" and got["http://b.com"]["verdict"] == "allow"
    assert (got["a://b?c://d.com/"]["host"], got["a://b?c://d.com/"]["path"]) == ("b", "")
    assert got[None]["host"] == "" and got["nothing"]["path"] == ""


# the pipeline

def test_stages_one_by_one(spark):
    docs = table(spark, SMOKE, "documents")
    extra = docs.withColumn("row", F.lit("r")).withColumn("Score", F.lit(1)).withColumn("kept", F.lit("k"))
    repeated = extra.unionByName(extra.limit(5)).unionByName(extra.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, repeated, SMOKE)
        assert out.columns == extra.columns, name
        assert 0 < out.count() <= repeated.count()
        assert stage(spark, extra.limit(0), SMOKE).count() == 0
    pieces = corpus_pipeline.packing(spark, repeated, SMOKE).collect()
    assert corpus_pipeline.packing(spark, extra.limit(0), SMOKE).count() == 0
    per = {}
    for r in pieces:
        per.setdefault(r["doc_id"], []).append(r)
    twice = {r["doc_id"] for r in extra.limit(5).collect()}
    for d, rows in per.items():  # each copy of a repeated row is packed whole
        assert sum(r["length"] for r in rows) == rows[0]["doc_tokens"] * (2 if d in twice else 1)
    assert set(per) == {r["doc_id"] for r in repeated.select("doc_id").collect()}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, None)], "doc_id bigint, text string")
    assert corpus_pipeline.quality_rules(spark, odd, SMOKE).count() == 0
    assert corpus_pipeline.decontaminate(spark, odd, SMOKE).count() == 4
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, odd, SMOKE).collect()] == [1]
    assert corpus_pipeline.packing(spark, odd, SMOKE).agg(F.sum("length")).first()[0] == 5
    groups = {r["doc_id"]: r["component_id"] for r in Q.op8_simhash_groups(spark, SMOKE).collect()}
    left = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, repeated, SMOKE).collect()]
    assert sorted(left) == sorted(set(groups.values()))


def test_pipeline_against_stagewise_decisions(spark):
    docs = table(spark, SMOKE, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = {r["doc_id"] for r in stage(spark, docs, SMOKE).select("doc_id").collect()}
        docs = docs.where(F.col("doc_id").isin(sorted(kept)))
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SMOKE).collect()
    assert {r["doc_id"] for r in rows} == want
    assert all(sum(x["length"] for x in rows if x["doc_id"] == r["doc_id"]) == r["doc_tokens"] for r in rows[:20])
