"""Main text of web pages by consensus host paths.

Pages of one host share a template. Each page's containers are scored by the
text that they hold, and the page votes for the generalised tag-class path of
its best one. Spark counts the votes by host; then every page is read again
with the winning paths of its host, so a page whose own content is thin or odd
is still cut where its siblings are.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import quoted, stored, with_columns

#: Elements by their role in HTML.
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
BLOCKS = CONTAINERS | frozenset(
    "address blockquote caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html "
    "legend li ol optgroup p pre search summary tfoot th thead ul".split())
DROPPED = frozenset("aside button canvas dialog footer form head iframe input label menu nav object select svg "
                    "template textarea audio video map".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = (BLOCKS | {"form", "nav", "aside", "header", "footer", "menu"}) - {
    "caption", "dd", "dt", "html", "legend", "li", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr",
    "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
#: Elements of these that hold the article are read all the same.
MAYBE = frozenset({"form"})
#: Names in class, id or role of what is not the article.
OUTSIDE = frozenset(
    "ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs byline "
    "comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disqus discussion footer "
    "form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination paywall popup promo promoted promotion recommended related replies reply "
    "respond share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola "
    "toast toolbar widget widgets".split())
#: Words that make a known compound with those names, as in share-buttons.
FRAME = frozenset(
    "area articles bar block bottom box buttons col column container global google group icons inner item items left "
    "links list main mobile outer panel placeholder posts primary right row secondary section site slot stories top "
    "unit wrap wrapper".split())
INSIDE = frozenset("article body content entry main post story text".split())
#: First words of names that tell what an element has or lacks, not what it is.
DESCRIBES = frozenset("has have hide is no non not show with without".split())
HEADINGS = frozenset("h1 h2 h3".split())

#: Hosts up to which their paths go to every task; beyond it Spark joins by host.
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?=[\s/=]|\Z)(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Steps that a path shows; the path of a deeper container begins with a hash of all its steps.
DEPTH = 12


class Node:
    """A container: its parent, the last steps of its path and a hash of all of
    them, whether an article or main element is around it, whether the page
    itself ends here, and the factor of its score."""
    __slots__ = ("parent", "steps", "depth", "hash", "in_main", "page", "factor")

    def __init__(self, parent, step, in_main, factor=1.0, page=False):
        self.parent, self.in_main, self.factor, self.page = parent, in_main, factor, page
        self.steps = (*parent.steps, step)[-DEPTH:] if parent else ()
        self.depth = parent.depth + 1 if parent else 0
        self.hash = zlib.crc32(step.encode(), parent.hash) if parent else 0

    @property
    def path(self):
        return (f"{self.hash:08x}:" if self.depth > DEPTH else "") + ">".join(self.steps)


class Doubt:
    """An element that its tag or name makes no article: the one around it, whether
    an article or main element is around it or in it, and its characters outside
    links, those inside an article or main element apart."""
    __slots__ = ("parent", "in_main", "has_main", "plain", "plain_main")

    def __init__(self, parent, in_main):
        self.parent, self.in_main, self.has_main, self.plain, self.plain_main = parent, in_main, False, 0, 0


def _outside(name: str, tag: str) -> bool:
    """Whether a name stands for what is not the article: one of these names, a
    compound of them and of frame words, or a name that begins or ends with one
    (user-comments, ad-label). A header may be called so, and an article's part
    may be its header (entry-header)."""
    words = [w.lower() for w in _WORD.findall(name) if len(w) > 1]
    parts = set(words)
    known = {name.lower()} & OUTSIDE or parts & OUTSIDE
    if tag == "header" or parts & INSIDE:
        known = known - {"header"}
    if not known or words and words[0] in DESCRIBES:
        return False
    return name.lower() in OUTSIDE or parts <= OUTSIDE | FRAME or bool({words[0], words[-1]} & known)


def _classes(attrs: str, tag: str) -> tuple[list[str], set[str], bool]:
    """Class names with digits made equal, the words in class, id and role, and
    whether one of these names what is not the article."""
    classes, words, outside = [], set(), False
    for name, a, b, c in _NAMES.findall(attrs):
        value = a or b or c
        words.update(w.lower() for w in _WORD.findall(value))
        outside = outside or any(_outside(v, tag) for v in value.split())
        if name.lower() == "class":
            classes += sorted({re.sub(r"\d+", "#", v.lower()) for v in value.split()})
    return classes, words, outside


def settled(containers: list[tuple[Node, Doubt | None]], blocks: list[tuple[Node, str, int, Doubt | None, bool]]):
    """Containers and blocks without the doubtful elements. One stays in if it
    holds an article or main element and lies in none, or if it holds most of
    the page's text outside links, unless it lies beside an article or main
    element with text. All stay in when no text would be left."""
    total, in_main = sum(b[2] for b in blocks), sum(b[2] for b in blocks if b[0].in_main)
    for node, _, plain, doubt, _ in blocks:
        while doubt:
            doubt.plain += plain
            doubt.plain_main += plain if node.in_main else 0
            doubt = doubt.parent
    known: dict[Doubt | None, bool] = {None: True}

    def stays(doubt):
        around = []
        while doubt not in known:
            around.append(doubt)
            doubt = doubt.parent
        for d in reversed(around):
            most = 2 * d.plain > total and (d.in_main or d.plain_main == in_main)
            known[d] = known[d.parent] and (most or d.has_main and not d.in_main)
        return known[around[0] if around else doubt]
    kept = [b for b in blocks if stays(b[3])]
    if sum(b[2] for b in kept) or not total:
        containers, blocks = [c for c in containers if stays(c[1])], kept
    return [c[0] for c in containers], [(b[0], b[1], b[2], b[4]) for b in blocks]


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int, bool]]]:
    """The page's containers and its blocks: (container, text, characters
    outside links, whether it is a heading) in page order. Blocks outside the
    article are left out."""
    root = Node(None, "", False, page=True)
    containers, blocks = [(root, None)], []
    stack: list[tuple[str, Node, bool, Doubt | None]] = []  # open elements with what is around them
    node, dropped, links = root, 0, 0  # dropped: open elements that are no article
    doubt: Doubt | None = None  # the innermost open element that may be none
    opened: dict[str, int] = defaultdict(int)
    text: list[str] = []
    plain = 0

    def flush():
        nonlocal text, plain
        if text:
            t = " ".join("".join(text).split())
            if t:
                blocks.append((node, t, plain, doubt, any(opened[h] for h in HEADINGS)))
            text, plain = [], 0

    def close(k):
        nonlocal node, dropped, links, doubt
        while len(stack) > k:
            tag, before, was_dropped, doubt = stack.pop()
            dropped -= was_dropped
            links -= tag == "a"
            opened[tag] -= 1
            node = before

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not dropped:
            piece = page[at:m.start()]
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            plain += 0 if links else len(piece)
        at = m.end()
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.lower()
        if m.group("end"):
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    if tag in BLOCKS or tag in DROPPED or tag == "header":
                        flush()
                    elif any(s[0] in BLOCKS for s in stack[k + 1:]):
                        break  # an inline end tag closes no block
                    close(k)
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            flush()
            shut = {"p"} if tag in CLOSES_P else SIBLINGS[tag]
            for k in range(len(stack) - 1, -1, -1) if any(opened[t] for t in shut) else ():
                if stack[k][0] in shut:
                    close(k)
                    break
                if stack[k][0] in CONTAINERS and stack[k][0] not in shut or stack[k][0] in ("ul", "ol", "dl"):
                    break
        if tag in VOID or m.group("attrs").endswith("/") and tag not in BLOCKS:
            if tag in BLOCKS:
                flush()
            continue
        attrs = m.group("attrs")
        classes, words, named = _classes(attrs, tag) if "=" in attrs else ([], set(), False)
        out = tag in DROPPED - MAYBE or bool(attrs) and _HIDDEN.search(attrs) is not None
        doubtful = tag in MAYBE or tag == "header" and not node.in_main
        if not doubtful and tag not in ("html", "body", "main") and not (tag == "article" and not node.in_main):
            doubtful = named
        if tag in BLOCKS or out or doubtful:
            flush()
        before, around = node, doubt
        main = tag in ("article", "main")
        if main and not out and not dropped:
            d = doubt
            while d and not d.has_main:
                d.has_main, d = True, d.parent
        if doubtful and not out and not dropped:
            doubt = Doubt(doubt, node.in_main)
        if tag in CONTAINERS:
            node = Node(node, ".".join([tag, *classes]), node.in_main or main,
                        1.25 if main else 1.15 if words & INSIDE else 1.0, node.page and tag == "body")
            if not out and not dropped:
                containers.append((node, doubt))
        stack.append((tag, before, out, around))
        opened[tag] += 1
        dropped += out
        links += tag == "a"
    if at < len(page) and not dropped:
        piece = html.unescape(page[at:])
        text.append(piece)
        plain += len(piece)
    flush()
    return settled(containers, blocks)


def best_container(containers: list[Node], blocks: list[tuple[Node, str, int, bool]]) -> Node | None:
    """The container with the most text outside links; each level above a
    block counts it for less. The first of equal ones; None without text."""
    held: dict[Node, float] = {}
    for node, _, plain, _ in blocks:
        weight = float(plain)
        while node is not None and weight > .01:
            held[node] = held.get(node, 0.0) + weight
            weight *= .85
            node = node.parent
    best, most = None, 0.0
    for c in containers:
        s = held.get(c, 0.0) * c.factor
        if s > most:
            best, most = c, s
    return best


def vote(page: str | None) -> str | None:
    best = best_container(*parse(page)) if page else None
    return best.path if best else None


def extract(page: str | None, paths: list[str] | None) -> tuple[str, str | None]:
    """(text, path): the blocks of the best container on the first of
    ``paths`` that the page has text on, else of the page's own best one."""
    if not page:
        return "", None
    containers, blocks = parse(page)
    top = None
    for p in paths or ():
        top = best_container([c for c in containers if c.path == p], blocks)
        if top:
            break
    top = top or best_container(containers, blocks)
    if top is None:  # no container holds text outside links
        return "\n".join(b[1] for b in blocks), None
    return "\n".join(blocks[k][1] for k in article_blocks(containers, blocks, top)), top.path


def article_blocks(containers: list[Node], blocks: list[tuple[Node, str, int, bool]], top: Node) -> list[int]:
    """The places of the blocks of the article whose main container is ``top``:
    those inside it; up to the page's body, also the texts beside it and its
    parents, such as a title, a lead or a continuation, that are no links; and a
    heading that stands in the body itself before it."""
    inside = {top}
    for c in containers:  # parents come first
        if c.parent in inside:
            inside.add(c)
    kept = {k for k, b in enumerate(blocks) if b[0] in inside}
    around = top
    while around.parent is not None and not around.parent.page:
        around = around.parent
        beside: dict[Node, list[int]] = defaultdict(list)  # by the child of ``around`` that holds them
        for k, (node, _, _, _) in enumerate(blocks):
            child = node
            while child is not None and child is not around and child.parent is not around:
                child = child.parent
            if child is not None and k not in kept:
                beside[child].append(k)
        for places in beside.values():
            if 2 * sum(blocks[k][2] for k in places) > sum(len(blocks[k][1]) for k in places):
                kept.update(places)
    first = min(kept, default=0)
    kept.update(k for k in range(first) if blocks[k][3] and blocks[k][0] is around.parent and 2 * blocks[k][2] > len(blocks[k][1]))
    return sorted(kept)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = .05,
                  keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` (blocks joined by a line feed) and ``main_path``.

    Votes are counted by (host, path) with partial sums, so a host of any size
    is a few rows after the first step; a host's winning paths are those with
    at least ``share`` of its votes (at most 1 / ``share``), most votes first,
    then by name: on a host of more templates than that a page whose path does
    not win is read by its own best container. Cases: a null or empty page has empty text and no path; a
    null url, or one without a host, votes in the host ''; a page whose host
    has no winning path on it uses its own best container; repeated rows vote
    and are read alike; extra columns stay, and those named like an output
    column give way to it.
    """
    # pages under the names of this step; the row's other columns travel in one struct
    cols = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "main_path")]
    src = pages.select(F.struct(*map(quoted, cols)).alias("row"), host_of(F.col(quoted(url_col))).alias("host"),
                       F.col(quoted(html_col)).alias("page"))

    def votes():
        return lambda col: [[vote(p) for p in col.to_pylist()]]
    voted = with_columns(src, ["page"], "path string", votes, keep=["host"]).where("path is not null")
    counts = voted.groupBy("host", "path").agg(F.count("*").alias("n"))
    all_votes = F.sum("n").over(Window.partitionBy("host"))
    winners = (counts.withColumn("all", all_votes).where(F.col("n") >= F.lit(share) * F.col("all"))
               .groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("w"))
               .select("host", F.col("w.path").alias("paths")))
    winners = stored(winners, "paths")
    small = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = src.join(F.broadcast(winners) if small else winners, "host", "left")

    def read():
        def f(page, paths):
            got = [extract(p, w) for p, w in zip(page.to_pylist(), paths.to_pylist())]
            return [[t for t, _ in got], [p for _, p in got]]
        return f
    out = with_columns(joined, ["page", "paths"], "text string, main_path string", read, keep=["row"])
    return out.select(*[F.col("row")[c].alias(c) for c in cols], "text", "main_path")
