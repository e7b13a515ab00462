"""Shared helpers: Arrow passes over a table, scratch tables, crc32 folds."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: later jobs do not
    recompute it, and a lost executor costs one task, not the lineage. ``codec``
    names the compression, the session's by default."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the scratch table of a frame that ``stored`` gave and that
    nothing reads any more (a later one was written from it)."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let_go(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of queries that are done: it does so
    for those that neither Python nor the JVM refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(col: Column | str, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts`` (null for a null value)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(parts)


def with_columns(df: DataFrame, uses: list[str], fields: str,
                 start: Callable[[], Callable[..., list]],
                 keep: list[str] | None = None) -> DataFrame:
    """Append computed columns in one Arrow pass, without a shuffle.

    ``start()`` runs once in each task and returns ``f(*arrays) -> list`` with
    one value list (or Arrow array) for each field. ``keep`` names the columns
    that stay (all by default). A column of ``df`` with the name of a new
    field, in any case, gives way to the new one.
    """
    new = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    read = kept + [c for c in dict.fromkeys(uses) if c not in kept]
    src = df.select(*[F.col(quoted(c)) for c in read])
    at, n_kept = [read.index(c) for c in uses], len(kept)
    schema = StructType([src.schema[c] for c in kept] + list(new))
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = [f.type for f in to_arrow_schema(new)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for whole in batches:
            for b in pieces(whole, at):
                made = f(*[b.column(i) for i in at])
                cols = [b.column(i) for i in range(n_kept)]
                cols += [v if isinstance(v, pa.Array) else pa.array(v, type=k)
                         for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, at: list[int], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes each, so that what a step
    builds on the side stays bounded however long the texts are."""
    n = batch.num_rows
    if not n:
        return
    size = sum(batch.column(i).nbytes for i in at)
    step = max(1, int(n * most / max(size, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def utf8(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text, None for null."""
    return col.cast(pa.binary()).to_pylist()
