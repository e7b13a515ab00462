"""CSV drops: listing (J03) and a header-aware scan.

Drops come with changing headers (old files lack columns, columns may be
reordered or many more than ours). ``records`` makes whole records of the files'
lines, also where many tasks read one file; Spark's CSV parser then takes each
record apart under the header of its own file. Records of all headers are
parsed in one pass, and nothing is joined but the headers (one row a file).
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from quire.schemas import PAPER_COLUMNS
from quire.sources.records import ends_inside, plain_name, read_records


class DropFile(NamedTuple):
    path: str
    length: int
    modified_ms: int

    @property
    def file_id(self) -> str:
        """The identity of one landed file: a new file under an old name is
        another file, the same file seen again is the same."""
        return hashlib.sha1(f"{self.path}|{self.modified_ms}|{self.length}".encode()).hexdigest()[:20]


def file_system(spark: SparkSession, path: str):
    """Hadoop's FileSystem for a path, and the path in its form."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_drops(spark: SparkSession, drop_dir: str, archive_dir: str | None = None,
               glob: str = "*.csv") -> list[DropFile]:
    """The drop files in path order, empty ones included: those of the folder
    and of its direct subfolders (``batch=...``). The archive, and a subfolder
    called ``archive``, are left out. Only metadata of what lies in the drop
    folder is read; loaded files leave it for the archive."""
    fs, root = file_system(spark, drop_dir)
    out = []
    away = {f"{drop_dir.rstrip('/')}/archive"} | ({archive_dir.rstrip("/")} if archive_dir else set())
    away = {str(fs.makeQualified(file_system(spark, a)[1]).toString()).rstrip("/") + "/" for a in away}
    for pattern in (glob, f"*/{glob}"):
        new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for st in fs.globStatus(new_path(root, pattern)) or []:
            path = st.getPath().toString()
            if st.isFile() and not any(path.startswith(a) for a in away):
                out.append(DropFile(path, st.getLen(), st.getModificationTime()))
    return sorted(set(out))


def input_files(spark: SparkSession, paths: list[str] | str) -> dict[str, int]:
    """The files that a scan of ``paths`` reads and their lengths."""
    out = {}
    for name in map(unquote, spark.read.text(paths).inputFiles()):
        fs, p = file_system(spark, name)
        out[name] = fs.getFileStatus(p).getLen()
    return out


def first_record(spark: SparkSession, path: str) -> str | None:
    """The text of a file's header, None for a file without records."""
    fs, p = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        lines, inside = [], False
        while (line := reader.readLine()) is not None:
            if not lines:
                line = line.removeprefix("\ufeff")
            if line or lines:
                lines.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    break
        return "\n".join(lines) if lines else None
    finally:
        reader.close()


#: How a record is read. Blanks around unquoted fields go, an empty unquoted
#: field is NULL, a doubled quote in a quoted field is one.
_CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true", "columnNameOfCorruptRecord": "_bad"}


def _schema(width: int) -> str:
    return ", ".join([*(f"_c{i} string" for i in range(width)), "_bad string"])


def header_names(spark: SparkSession, headers: list[str]) -> list[list[str]]:
    """The column names of each header text, in lower case without outer blanks."""
    if not headers:
        return []
    one = spark.range(1)
    options = {k: v for k, v in _CSV.items() if k != "columnNameOfCorruptRecord"} | {"maxColumns": _most(headers)}
    found = one.select(*[F.schema_of_csv(F.lit(h), options).alias(f"h{i}") for i, h in enumerate(headers)]).first()
    widths = [len(StructType.fromDDL(x[7:-1]).fields) for x in found]
    parsed = one.select(*[F.from_csv(F.lit(h), _schema(w), {**_CSV, **options}).alias(f"h{i}")
                          for i, (h, w) in enumerate(zip(headers, widths))]).first()
    return [[(x or "").strip().lower() for x in r[:w]] for r, w in zip(parsed, widths)]


def _most(headers: list[str]) -> str:
    """A limit of columns that no header reaches."""
    return str(max(20_480, *(h.count(",") + 2 for h in headers)))


def _fields(names: list[str], options: dict[str, str]) -> Column:
    """The canonical fields of a record under one header, parsed once."""
    width = len(names)
    record = F.from_csv("raw", _schema(width), options)
    present = [c for c in PAPER_COLUMNS if c in names]

    def canonical(r: Column) -> Column:
        # a record of one blank field has no values at all
        return F.struct((r["_bad"].isNotNull() | r.isNull() & F.lit(width > 1)).alias("ragged"),
                        F.array(*map(F.lit, present)).cast("array<string>").alias("present"),
                        *[(r[f"_c{names.index(c)}"] if c in present else F.lit(None).cast("string")).alias(c)
                          for c in PAPER_COLUMNS])
    return F.element_at(F.transform(F.array(record), canonical), 1)


#: Rows of one file among which rejected ones are counted together.
BIN = 1000
#: Headers whose records are parsed by one expression; more go in further scans.
HEADERS_PER_SCAN = 200


def read_drops(spark: SparkSession, paths: list[str] | str, headers: bool = False,
               reject_ragged: bool = False) -> DataFrame:
    """Data rows with the canonical paper columns (text) and ``file_name``,
    ``row_no`` (1, 2, ... within the file), ``good_no`` (the same without
    rejected rows; NULL for those), ``ragged`` (not as many fields as the
    header), ``seen_at`` and ``present`` (canonical columns of the header).

    A column missing from a file's header, and a field missing from a short
    row, is NULL; text after a closing quote stays in its field. With
    ``headers`` each file's header is a row too, with ``row_no`` 0, so that
    files without data rows are seen. A file that the reader splits is read by
    as many tasks as it has blocks, with the same rows and numbers.
    """
    files = input_files(spark, paths)
    conf = spark._jsparkSession.sessionState().conf()
    whole = min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())  # never split up to this length
    records = read_records(spark, paths, [f for f, n in files.items() if n > whole])
    heads = {plain_name(f): first_record(spark, f) for f, n in files.items() if n}
    texts = sorted({h for h in heads.values() if h is not None})
    names, options = header_names(spark, texts), {**_CSV, "maxColumns": _most(texts) if texts else "20480"}
    number = {h: i for i, h in enumerate(texts)}
    of_file = spark.createDataFrame([(f, number[h]) for f, h in heads.items() if h is not None],
                                    "file_name string, _header int")
    out = None
    for i in range(0, max(1, len(texts)), HEADERS_PER_SCAN):
        parsed = F.lit(None)
        for k in range(i, min(i + HEADERS_PER_SCAN, len(texts))):
            parsed = F.when(F.col("_header") == k, _fields(names[k], options)).otherwise(parsed)
        here = of_file.where(F.col("_header").between(i, i + HEADERS_PER_SCAN - 1))
        if not texts:
            parsed = _fields(["url"], options)
        part = (records.join(F.broadcast(here), "file_name").where(F.lit(headers) | (F.col("row_no") > 0))
                .select("file_name", "row_no", "seen_at", parsed.alias("_f")))
        out = part if out is None else out.unionByName(part)
    ragged = F.col("_f.ragged") & (F.col("row_no") > 0)
    out = out.select("file_name", "row_no", ragged.alias("ragged"), "seen_at", "_f.present",
                     *[F.col(f"_f.{c}").alias(c) for c in PAPER_COLUMNS])
    if not reject_ragged:
        return out.withColumn("good_no", F.when(F.col("row_no") > 0, F.col("row_no")))
    # rejected rows are counted by bins of rows, and before a row within its bin
    out = out.withColumn("_bin", F.floor(F.col("row_no") / BIN))
    bins = out.groupBy("file_name", "_bin").agg(
        F.collect_list(F.when(F.col("ragged"), F.col("row_no"))).alias("_bad"))
    earlier = Window.partitionBy("file_name").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum(F.size("_bad")).over(earlier), F.lit(0)))
    bad = F.col("_before") + F.size(F.filter("_bad", lambda n: n < F.col("row_no")))
    good = F.when((F.col("row_no") > 0) & ~F.col("ragged"), F.col("row_no") - bad)
    return out.join(bins, ["file_name", "_bin"]).withColumn("good_no", good).drop("_bin", "_bad", "_before")
