"""Exact URL lists by a cascade of Bloom filters, DataFrame operations only.

The first filter holds the listed keys, the second the corpus's other keys
that pass the first, the third the listed keys that pass the second, and so
on until none is left. Over the complete universe of keys the first filter
that a key fails tells exactly whether it is listed. The filters are words of
64 bits in one array each, read through scalar subqueries: applying them needs
no join and no shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import quoted, stored

BITS_PER_KEY = 10
HASHES = 7
#: Largest filter, 16 MB. More keys than fit go in passes over ranges of their hash.
MOST_BITS = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``(verdict, host/path)`` rules that fits, as a struct
    (rule, verdict), null if none does; of equal ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        h, slash, p = rule.partition("/")
        fits = (host_col == h) | host_col.endswith("." + h)
        fits = fits & path_col.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _place(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("bigint"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))


class Filter:
    """One level: a stored one-row table with the words of the filter."""

    def __init__(self, keys: DataFrame, level: int, n: int):
        self.level = level
        self.bits = bits = max(1024, 64 * math.ceil(n * BITS_PER_KEY / 64))
        places = keys.select(F.explode(F.array(*[_place(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(_bit(F.col("p"))).alias("b"))
        # one row of at most MOST_BITS bits; absent words are zero
        every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"),
                                                           F.lit(0).cast("bigint").alias("b"))
        row = (words.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
               .agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("s"))
               .select(F.col("s.b").alias("words")))
        self.words = stored(row, f"bloom{level}")

    def passes(self, key: Column) -> Column:
        words = self.words.select("words").scalar()
        hit = [(F.get(words, F.shiftright(p, 6).cast("int")).bitwiseAND(_bit(p)) != 0)
               for p in (_place(key, self.level, i, self.bits) for i in range(HASHES))]
        return reduce(lambda a, b: a & b, hit)


class Cascade:
    """Filters for a universe (key, listed) of distinct keys."""

    def __init__(self, universe: DataFrame):
        inside, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
        self.levels: list[Filter] = []
        n = inside.count()
        while n:
            f = Filter(inside, len(self.levels), n)
            self.levels.append(f)
            # those of the other side that pass are held by the next level
            inside, other = stored(other.where(f.passes(F.col("key"))), "passed"), inside
            n = inside.count()

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; null is not."""
        out = F.lit(len(self.levels) % 2 == 1)
        for f in reversed(self.levels):
            # failing a level of listed keys: not listed; of others: listed
            out = F.when(f.passes(key), out).otherwise(F.lit(f.level % 2 == 1))
        return F.coalesce(out & key.isNotNull(), F.lit(False))


def mark_listed(rows: DataFrame, key_col: str, listed: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Add ``listed``: whether ``key_col`` is among the keys of ``listed`` (its
    first column), exact for every row.

    The universe is every distinct key of both tables, counted with partial
    sums. More listed keys than one filter may hold are cut into ranges of a
    hash, each with its own cascade and one pass over the rows of that range.
    Cases: a null key is not listed; null and repeated listed keys change
    nothing; with no listed keys every row is false; an input column named
    ``listed`` gives way to the new one.
    """
    mine = rows.select(F.col(quoted(key_col)).cast("string").alias("key"), F.lit(False).alias("listed"))
    theirs = listed.select(F.col(quoted(listed.columns[0])).cast("string").alias("key"), F.lit(True).alias("listed"))
    universe = mine.unionByName(theirs).where("key is not null").groupBy("key").agg(F.max("listed").alias("listed"))
    universe = stored(universe, "universe")
    parts = max(1, math.ceil(universe.where("listed").count() * BITS_PER_KEY / most_bits))
    cols = [c for c in rows.columns if c.lower() != "listed"]
    key = F.col(quoted(key_col)).cast("string")
    out = None
    for part in range(parts):
        of = lambda k: F.pmod(F.xxhash64(k, F.lit("range")), F.lit(parts)) == part
        cascade = Cascade(universe.where(of(F.col("key"))) if parts > 1 else universe)
        some = rows.where(F.coalesce(of(key), F.lit(part == 0))) if parts > 1 else rows
        some = some.select(*map(quoted, cols), cascade.listed(key).alias("listed"))
        out = some if out is None else out.unionByName(some)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url_col: str = "url",
               keep: list[str] | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``: that of the longest
    rule that fits, else ``block`` for a key (host and path joined) in
    ``listed`` and ``allow`` for others.

    Cases: urls of any length are judged whole; a null url, or one without
    ``://``, has empty host and path and the
    empty key, which is judged like any other; repeated rows are judged alike;
    an input column named like an output column gives way to it.
    """
    made = {"host", "path", "rule", "verdict"}
    cols = [c for c in (pages.columns if keep is None else keep) if c.lower() not in made]
    url = F.col(quoted(url_col))
    src = pages.select(F.struct(*map(quoted, cols)).alias("row"), host(url).alias("host"), path(url).alias("path"))
    src = src.withColumn("key", F.concat("host", "path"))
    marked = mark_listed(src, "key", listed).withColumn("fits", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return marked.select(*[F.col("row")[c].alias(c) for c in cols], "host", "path",
                         F.col("fits.rule").alias("rule"), verdict.alias("verdict"))
