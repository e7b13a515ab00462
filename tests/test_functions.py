"""Column expressions against the semantics they must reproduce."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from quire.functions.dates import parse_int, parse_pub_date, parse_timestamp
from quire.functions.duration import duration_text
from quire.functions.inverted import text_from_inverted_index
from quire.functions.text import join_names, last_segment, py_strip, strip_markup


def _one(spark, col, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("r")).first()["r"]


def test_publication_dates(spark):
    cases = {
        "2025-04-07": dt.date(2025, 4, 7), "2025-04": dt.date(2025, 4, 1),
        "2025": dt.date(2025, 1, 1), "2025-4-7": dt.date(2025, 4, 7), "1899": None,
        "None": None, "": None, None: None, "  2024-02-29 ": dt.date(2024, 2, 29),
        "2025-02-30": None, "7 April 2025": dt.date(2025, 4, 7), "April 2025": dt.date(2025, 4, 1),
        "2021-05-06T10:00:00Z": dt.date(2021, 5, 6), "2100": dt.date(2100, 1, 1), "2101": None,
        "2025-4": dt.date(2025, 4, 1), "garbage": None,
        "2025/04/07": dt.date(2025, 4, 7), "04/07/2025": dt.date(2025, 4, 7),
        "4/7/2025": dt.date(2025, 4, 7), "13/01/2025": None, "Mar 2021": dt.date(2021, 3, 1),
        "12 Mar 2021": dt.date(2021, 3, 12), "March 12, 2021": dt.date(2021, 3, 12),
        "Mar 5, 2020": dt.date(2020, 3, 5), "Spring 2020": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.d for r in df.select("v", parse_pub_date(F.col("v")).alias("d")).collect()}
    assert got == cases


def test_ints_and_timestamps(spark):
    ints = {" 12 ": 12, "+5": 5, "-3": -3, "5.0": None, "n/a": None, "": None,
            "2147483647": 2147483647, "2147483648": None}
    df = spark.createDataFrame([(k,) for k in ints], "v string")
    assert {r.v: r.i for r in df.select("v", parse_int(F.col("v")).alias("i")).collect()} == ints
    ts = {"2025-04-07 10:11:12": dt.datetime(2025, 4, 7, 10, 11, 12),
          "2025-04-07T10:11:12": dt.datetime(2025, 4, 7, 10, 11, 12),
          "2025-04-07": dt.datetime(2025, 4, 7), "soon": None}
    df = spark.createDataFrame([(k,) for k in ts], "v string")
    out = df.select("v", parse_timestamp(F.col("v")).alias("t"))
    assert dict(out.collect()) == ts
    assert out.schema["t"].dataType.typeName() == "timestamp_ntz"


def test_py_strip_matches_python(spark):
    rnd = random.Random(7)
    alphabet = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ",
                "　", "​", "a", "b", "\x00", "\x07"]
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.s for r in df.select("i", py_strip(F.col("v")).alias("s")).collect()}
    assert all(got[i] == v.strip() for i, v in enumerate(values))


def test_strip_markup_matches_python(spark):
    vals = ["<jats:p>Hello <b>world</b></jats:p>\n", "  a < b > c ", "<x\ny>t</x>", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.s for r in df.select(strip_markup(F.col("v")).alias("s")).collect()]
    assert got == [re.sub(r"<[^>]+>", "", v or "").strip() for v in vals]


def test_inverted_index_first_position(spark):
    inv = {"b": [1, 3], "a": [0], "c": [2]}
    assert _one(spark, text_from_inverted_index(F.col("v")), inv, "v map<string,array<int>>") == "a b c"
    assert _one(spark, text_from_inverted_index(F.col("v")), None, "v map<string,array<int>>") == ""


def test_join_names_and_segments(spark):
    arr = [{"name": "A"}, {"name": None}, {"name": "C"}]
    assert _one(spark, join_names(F.col("v"), "name"), arr, "v array<struct<name:string>>") == "A, , C"
    assert _one(spark, join_names(F.col("v"), "name"), None, "v array<struct<name:string>>") == ""
    assert _one(spark, last_segment(F.col("v"), "/abs/"), "http://x/abs/2401.1v2") == "2401.1v2"
    assert _one(spark, last_segment(F.col("v"), "/"), "https://openalex.org/W1/") == ""
    assert _one(spark, last_segment(F.col("v"), "/abs/"), "no marker") == "no marker"


def test_duration_text(spark):
    cases = {5.0: "5.0초", 59.94: "59.9초", 61.0: "1분 1초", 3599.0: "59분 59초",
             3600.0: "1.0시간", 5400.0: "1.5시간"}
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    assert dict(df.select("v", duration_text(F.col("v"))).collect()) == cases


def test_index_of_texts(spark):
    from quire.plans.payload_fixtures import with_inverted_index
    texts = ["b a  b", "", None, "é z\U0001f642 é ￮", " ", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    got = {r["i"]: r for r in with_inverted_index(df, when=F.col("i") < 5).withColumn("j", F.to_json("inv")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None or i == 5 else {w: [k for k, x in enumerate(t.split(" ")) if x == w] for w in t.split(" ")}
        assert got[i]["inv"] == want
    assert got[0]["j"] == '{"":[2],"a":[1],"b":[0,3]}'  # words in order
    df = spark.createDataFrame([({"a": [5, 1], "b": None, "c": [3]},), ({},), (None,)], "v map<string,array<int>>")
    assert [r[0] for r in df.select(text_from_inverted_index(F.col("v"))).collect()] == ["b a c", "", ""]
