"""Fixture views that give the paper and load-log schemas from test tables.

They only shape rows (FIXTURES.md §4); none of a job's work happens here. The
same rules are kept as DuckDB SQL text (``*_SQL``) for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def papers_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    number = doc - F.when((doc % 3 == 0) & (doc >= 20), 20).otherwise(0)
    pub = F.when(doc % 7 == 0, F.lit(None)).otherwise(F.to_date(F.concat(
        F.lit("20"), F.lpad(_s(doc % 25), 2, "0"), F.lit("-0"), _s(1 + doc % 9), F.lit("-15"))))
    return d.select(
        (doc + 1).alias("seq"),
        F.concat(F.lit("https://example.org/doc/"), _s(doc)).alias("url"),
        F.col("source").alias("site_name"),
        F.concat(F.lit("kw"), _s(F.floor(doc / 20.0).cast("long") % 20)).alias("keyword"),
        F.concat(F.lit("P"), _s(number)).alias("paper_number"),
        F.left(F.col("text"), F.lit(60)).alias("title"),
        F.concat(F.col("lang"), F.lit(" One, "), F.col("source"), F.lit(" Two")).alias("authors"),
        pub.alias("published_date"),
        F.when(doc % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("10.1000/"), _s(doc))).alias("doi"),
        F.col("text").alias("abstract"),
        F.when(doc % 5 == 0, F.lit(None)).otherwise((F.col("n_chars") % 100).cast("int"))
        .alias("citation_count"),
        F.when(doc % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("J"), _s(doc % 10)))
        .alias("journal"),
    )


def load_log_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    st, ck = F.col("o_orderstatus"), F.col("o_custkey")
    return o.select(
        (F.col("o_orderkey") + 1).alias("log_id"),
        F.concat(F.lit("drop_"), _s(ck), F.lit(".csv")).alias("file_name"),
        F.when(st == "O", 0).otherwise(ck.cast("int") + 1).alias("total_rows"),
        F.when(st == "O", 0).when(st == "P", ck.cast("int")).otherwise(ck.cast("int") + 1)
        .alias("loaded_rows"),
        F.when(st == "P", 1).otherwise(0).alias("failed_rows"),
        F.when(st == "F", "SUCCESS").when(st == "P", "PARTIAL").otherwise("FAILED").alias("status"),
        F.when(st == "O", F.lit("timeout")).alias("error_msg"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"),
        F.timestamp_add("SECOND", ck % 9000, F.col("o_orderdate").cast("timestamp_ntz"))
        .alias("finished_at"),
    )


PAPERS_FX_SQL = """
papers_fx AS (
SELECT doc_id + 1 AS seq,
       concat('https://example.org/doc/', cast(doc_id AS varchar)) AS url,
       source AS site_name,
       concat('kw', cast(cast(floor(doc_id / 20.0) AS bigint) % 20 AS varchar)) AS keyword,
       concat('P', cast(doc_id - CASE WHEN doc_id % 3 = 0 AND doc_id >= 20 THEN 20 ELSE 0 END AS varchar)) AS paper_number,
       left(text, 60) AS title,
       concat(lang, ' One, ', source, ' Two') AS authors,
       CASE WHEN doc_id % 7 = 0 THEN NULL
            ELSE cast(concat('20', lpad(cast(doc_id % 25 AS varchar), 2, '0'), '-0', cast(1 + doc_id % 9 AS varchar), '-15') AS date) END AS published_date,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('10.1000/', cast(doc_id AS varchar)) END AS doi,
       text AS abstract,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE cast(n_chars % 100 AS int) END AS citation_count,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('J', cast(doc_id % 10 AS varchar)) END AS journal
FROM documents)
"""

LOAD_LOG_FX_SQL = """
load_log_fx AS (
SELECT o_orderkey + 1 AS log_id,
       concat('drop_', cast(o_custkey AS varchar), '.csv') AS file_name,
       CASE WHEN o_orderstatus = 'O' THEN 0 ELSE cast(o_custkey AS int) + 1 END AS total_rows,
       CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN cast(o_custkey AS int) ELSE cast(o_custkey AS int) + 1 END AS loaded_rows,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS failed_rows,
       CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'PARTIAL' ELSE 'FAILED' END AS status,
       CASE WHEN o_orderstatus = 'O' THEN 'timeout' END AS error_msg,
       o_orderdate AS started_at,
       o_orderdate + (o_custkey % 9000) * INTERVAL '1' SECOND AS finished_at
FROM orders)
"""


def with_views(*views: str) -> str:
    """``WITH`` prefix for oracle SQL using the named fixture views."""
    return "WITH " + ",\n".join(views) + "\n"
