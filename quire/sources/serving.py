"""Tables beside the paper table from which listings are served.

All are Parquet tables that Spark jobs derive from the stored papers:

* ``_grams``: for each loaded file its distinct (keyword, site) pairs with their
  numbers of rows, and the three-letter pieces of either text. A substring
  filter finds candidate pairs by the pieces of its pattern, checks them with
  the filter itself, and reads only the files that hold one (J60a). The total is
  the sum of the pairs' numbers.
* ``_sums``: for each loaded file the papers and citations of each site, from
  which site lists and means are merged (J62, J70).
* ``_order``: the sort keys of all papers in ranges with the number of rows in
  each, so any page reads the ranges that hold it (J60).

The first two are partitions by the file's identity, written whenever a file's
papers are, and replaced with them; the last is built anew over the whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quire.operators.query import AUTHORS_CUT, LISTING_COLUMNS, SORTABLE, _present, filter_papers, list_papers
from quire.schemas import PAPER_STORED
from quire.session import scratch_path
from quire.sources.drops import file_system
from quire.sources.segments import range_count, read_stored
from quire.sources.tables import exists, read_papers, read_table

S, L = T.StringType(), T.LongType()
GRAMS = T.StructType([T.StructField("col", S), T.StructField("gram", S), T.StructField("keyword", S),
                      T.StructField("site_name", S), T.StructField("n", L), T.StructField("file_id", S)])
SUMS = T.StructType([T.StructField("site_name", S), T.StructField("papers", L), T.StructField("cited", L),
                     T.StructField("citations", L), T.StructField("file_id", S)])
#: Rows of one range of the order table.
RANGE_ROWS = 100_000


def _beside(table_path: str, name: str) -> str:
    return f"{table_path.rstrip('/')}_{name}"


def stored_papers(spark: SparkSession, table_path: str) -> DataFrame:
    """The papers with the identity of their file, which prunes partitions."""
    return read_stored(spark, table_path)


def pieces(text: Column) -> Column:
    """The distinct three-letter pieces of a text, in lower case as ILIKE
    compares; a shorter text has none."""
    low = F.lower(text)
    return F.when(F.length(low) > 2, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))).otherwise(F.array().cast("array<string>"))


def grams_of(papers: DataFrame) -> DataFrame:
    """GRAMS rows: one with an empty column name for each pair of a file, and
    one for each piece of its texts."""
    pairs = papers.groupBy("file_id", "keyword", "site_name").agg(F.count(F.lit(1)).alias("n"))
    none = F.array(F.struct(F.lit("").alias("col"), F.lit("").alias("gram")))

    def of(c: str) -> Column:
        return F.transform(F.coalesce(pieces(F.col(c)), F.array().cast("array<string>")),
                           lambda g: F.struct(F.lit(c).alias("col"), g.alias("gram")))
    found = [of("keyword"), of("site_name")]
    return pairs.select("*", F.explode(F.concat(none, *found)).alias("g")).select(
        "g.col", "g.gram", "keyword", "site_name", "n", "file_id")


def sums_of(papers: DataFrame) -> DataFrame:
    return papers.groupBy("file_id", "site_name").agg(
        F.count(F.lit(1)).alias("papers"), F.count("citation_count").alias("cited"),
        F.sum(F.col("citation_count").cast("bigint")).alias("citations")).select(*SUMS.fieldNames())


def write_serving(spark: SparkSession, table_path: str, file_ids: list[str] | None = None) -> None:
    """Write the pieces and sums of some files (all by default) from their
    stored papers. Writing a file again replaces its partitions."""
    papers = stored_papers(spark, table_path)
    if file_ids is not None:
        papers = papers.where(F.col("file_id").isin(*file_ids))
    for name, rows in (("grams", grams_of(papers).repartition("file_id").sortWithinPartitions("file_id", "col", "gram")),
                       ("sums", sums_of(papers))):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id") \
            .parquet(_beside(table_path, name))


def read_grams(spark: SparkSession, table_path: str) -> DataFrame:
    return read_table(spark, _beside(table_path, "grams"), GRAMS)


def pattern_pieces(spark: SparkSession, text: str) -> list[str]:
    """The pieces that every text has which the filter finds: those of the runs
    between the wildcards that the user typed."""
    low = spark.range(1).select(F.lower(F.lit(text))).first()[0]
    return sorted({run[i:i + 3] for run in re.split("[%_]", low) for i in range(len(run) - 2)})


def matching_pairs(spark: SparkSession, table_path: str, keyword: str | None = None, site: str | None = None) -> DataFrame:
    """(file_id, keyword, site_name, n): the pairs of each file that the filters
    keep. Pairs with all pieces of the patterns are checked by the filters; a
    filter without pieces checks all pairs."""
    grams, found = read_grams(spark, table_path), None
    for c, text in (("keyword", keyword), ("site_name", site)):
        asked = pattern_pieces(spark, (text or "").strip())
        if asked:
            pairs = (grams.where((F.col("col") == c) & F.col("gram").isin(*asked))
                     .groupBy("file_id", "keyword", "site_name").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
                     .where(F.col("k") == len(asked)).drop("k"))
            found = pairs if found is None else _same(found, pairs.drop("n"))
    if found is None:
        found = grams.where("col = ''").select("file_id", "keyword", "site_name", "n")
    return filter_papers(found, keyword, site)


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose file, keyword and site are in ``right``; NULL equals NULL."""
    a, b = left.alias("a"), right.alias("b")
    on = (F.col("a.file_id") == F.col("b.file_id")) & F.col("a.keyword").eqNullSafe(F.col("b.keyword")) \
        & F.col("a.site_name").eqNullSafe(F.col("b.site_name"))
    return a.join(b, on, "left_semi")


def list_by_pieces(spark: SparkSession, table_path: str, keyword: str | None = None, site: str | None = None,
                   **page) -> DataFrame:
    """``list_papers`` of the stored papers with the filters answered by the
    piece table: rows, order and total are the same, read from the files that
    hold a matching pair."""
    pairs = matching_pairs(spark, table_path, keyword, site)
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    rows = _same(stored_papers(spark, table_path), pairs.drop("n")).drop("file_id")
    return list_papers(rows, total=total, **page)


def read_sums(spark: SparkSession, table_path: str) -> DataFrame:
    return read_table(spark, _beside(table_path, "sums"), SUMS)


def sites_from_sums(spark: SparkSession, table_path: str) -> DataFrame:
    """The distinct site names, ascending, without reading a paper."""
    return read_sums(spark, table_path).where("site_name is not null").select("site_name").distinct().orderBy("site_name")


def citations_from_sums(spark: SparkSession, table_path: str) -> DataFrame:
    """Papers with citations and their mean, per site, by mean descending."""
    merged = read_sums(spark, table_path).groupBy("site_name").agg(F.sum("cited").alias("papers"), F.sum("citations").alias("c"))
    return (merged.where("papers > 0").select("site_name", "papers", (F.col("c").cast("double") / F.col("papers")).alias("avg_citations"))
            .orderBy(F.desc("avg_citations"), "site_name"))


def _order_keys(sort: str, asc: bool) -> list[Column]:
    return [F.col("key").asc_nulls_first() if asc else F.col("key").desc_nulls_last(), F.asc("seq") if asc else F.desc("seq")]


def write_order(spark: SparkSession, table_path: str, sort: str, range_rows: int = RANGE_ROWS) -> None:
    """Build the order table of one sort column anew: (key, seq) of all papers
    in ranges, a folder for each, ascending with NULLs first; and the number of
    rows of each range."""
    if sort not in SORTABLE:
        raise ValueError(f"not a sort column: {sort}")
    papers = read_papers(spark, table_path)
    rows = papers.select(F.col(sort).alias("key"), "seq")
    n = range_count(rows.count(), range_rows, RANGE_ROWS)
    path, fresh = f"{_beside(table_path, 'order')}/{sort}", scratch_path(spark, "order")
    (rows.repartitionByRange(n, *_order_keys(sort, True)).sortWithinPartitions(*_order_keys(sort, True))
     .withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{fresh}/keys"))
    keys = spark.read.schema(_key_schema(sort)).parquet(f"{fresh}/keys")
    keys.groupBy("part").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{fresh}/counts")
    fs, to = file_system(spark, path)
    fs.mkdirs(to.getParent())
    fs.delete(to, True)
    if not fs.rename(file_system(spark, fresh)[1], to):
        raise OSError(f"cannot put {path} in place")


def _key_schema(sort: str) -> T.StructType:
    return T.StructType([T.StructField("key", PAPER_STORED[sort].dataType), T.StructField("seq", L), T.StructField("part", T.IntegerType())])


def page_by_order(spark: SparkSession, table_path: str, sort: str, order: str | None = None, skip: int = 0,
                  take: int = 20) -> DataFrame:
    """A page of all papers at any offset: the counts tell which ranges hold it,
    their keys which papers, and these are read by their numbers. Rows and order
    are those of ``list_papers``; what is read does not grow with ``skip``."""
    path, asc = f"{_beside(table_path, 'order')}/{sort}", order == "asc"
    papers = read_papers(spark, table_path)
    if not exists(spark, path):
        raise FileNotFoundError(f"no order table at {path}: write_order makes it")
    skip, take = max(int(skip), 0), max(int(take), 0)
    counts = sorted(((r["part"], r["n"]) for r in spark.read.parquet(f"{path}/counts").collect()), reverse=not asc)
    total, before, parts, left = sum(n for _, n in counts), 0, [], 0
    for part, n in counts:
        if before < skip + take and before + n > skip:
            if not parts:
                left = skip - before
            parts.append(part)
        before += n
    keys = spark.read.schema(_key_schema(sort)).parquet(f"{path}/keys").where(F.col("part").isin(*parts))
    seqs = [r["seq"] for r in keys.orderBy(*_order_keys(sort, asc)).offset(left).limit(take).collect()] if parts else []
    cols = _present(papers, LISTING_COLUMNS)
    shown = [F.left(c, F.lit(AUTHORS_CUT)).alias(c) if c == "authors" else F.col(c) for c in cols]
    main = F.col(sort).asc_nulls_first() if asc else F.col(sort).desc_nulls_last()
    rows = papers.where(F.col("seq").isin(*seqs)).orderBy(main, F.asc("seq") if asc else F.desc("seq"))
    return rows.select(F.lit(total).cast("bigint").alias("total_count"), *shown)
