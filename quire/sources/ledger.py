"""The ledger of keys already harvested, stored in buckets by key.

The ledger is a table in files at a path of its own: a partition for each
harvest, in it a file for each bucket of the key's hash. Spark knows the
buckets, so an anti join reads each bucket beside the new keys of the same hash:
only the batch is shuffled, never the ledger. The number of buckets is written
once beside the ledger, since all its files must agree on it.
"""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quire.schemas import LEDGER
from quire.sources.drops import file_system
from quire.sources.tables import exists, read_table

KEY = ["site_name", "paper_number"]
SPEC = T.StructType([T.StructField("buckets", T.IntegerType(), False)])


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spec_path(path: str) -> str:
    return f"{path.rstrip('/')}_buckets"


def ledger_buckets(spark: SparkSession, path: str, buckets: int | None = None) -> int:
    """The ledger's number of buckets; a new ledger gets ``buckets``, by default
    as many as the session's shuffles have partitions."""
    spec = _spec_path(path)
    if not exists(spark, spec):
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(buckets,)], SPEC).coalesce(1).write.mode("overwrite").parquet(spec)
    return read_table(spark, spec, SPEC).first()["buckets"]


def ledger_table(spark: SparkSession, path: str, buckets: int | None = None) -> str:
    """Make the ledger at ``path`` known to this session, with the harvests that
    have come since, and give the name of the table."""
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    n = ledger_buckets(spark, path, buckets)
    place = fs.makeQualified(p).toString()
    name = "quire_ledger_" + hashlib.sha1(f"{place}|{n}".encode()).hexdigest()[:16]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch_id string) USING parquet PARTITIONED BY (batch_id) "
              f"CLUSTERED BY ({', '.join(KEY)}) INTO {n} BUCKETS LOCATION {_literal(place)}")
    spark.catalog.recoverPartitions(name)
    return name


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The non-blank ``(site_name, paper_number)`` keys, in the ledger's
    buckets; a missing ledger reads as empty. A key of several harvests comes
    several times, which an anti join does not mind."""
    df = spark.table(ledger_table(spark, path)) if path and exists(spark, path) else spark.createDataFrame([], LEDGER)
    return df.where((F.length("site_name") > 0) & (F.length("paper_number") > 0)).select(*KEY)


def append_ledger(papers: DataFrame, path: str, batch_id: str, buckets: int | None = None) -> None:
    """Known keys of a run: ``site_name, paper_number, extracted_at``, one file
    for each bucket. Repeating a run replaces its own partition."""
    spark = papers.sparkSession
    name = ledger_table(spark, path, buckets)
    keys = papers.select(*LEDGER.fieldNames()).repartition(ledger_buckets(spark, path, buckets), *KEY)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch_id = {_literal(batch_id)}) SELECT * FROM {{keys}}", keys=keys)


def compact_ledger(spark: SparkSession, path: str) -> None:
    """Rewrite all harvests as one partition with each key once, the earliest
    ``extracted_at``, in the same buckets and without a shuffle. The new
    partition is complete before the old ones go; after a crash between the two
    steps keys are there twice, which changes no result, and the next call
    removes them."""
    name = ledger_table(spark, path)
    old = [r["partition"].removeprefix("batch_id=") for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    if len(old) < 2:
        return
    whole = f"compacted-{hashlib.sha1('|'.join(sorted(old)).encode()).hexdigest()[:12]}"
    keys = spark.table(name).groupBy(*KEY).agg(F.min("extracted_at").alias("extracted_at"))
    keys = keys.select(*LEDGER.fieldNames())
    spark.sql(f"INSERT INTO {name} PARTITION (batch_id = {_literal(whole)}) SELECT * FROM {{keys}}", keys=keys)
    for b in old:  # folder names are escaped
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (batch_id = {_literal(unquote(b))})")
        fs, p = file_system(spark, f"{path.rstrip('/')}/batch_id={b}")
        fs.delete(p, True)
    spark.catalog.refreshTable(name)
