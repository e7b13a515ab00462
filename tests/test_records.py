"""Records of files that several tasks read, against one-task reads."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.plans.load_run import clean_drops, run_load
from quire.sources.drops import first_record, header_names, read_drops
from quire.sources.records import block_states, block_summaries, ends_inside, lines_of, plain_name, read_records
from quire.sources.tables import read_papers


@pytest.fixture()
def small_blocks(spark):
    """Blocks of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "250")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def machine(line, inside):
    """``ends_inside`` character by character."""
    state = "quoted" if inside else "begin"
    i = 0
    while i < len(line):
        c = line[i]
        if state == "quoted":
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "after"
        elif c == ",":
            state = "begin"
        elif state == "begin" and c == '"':
            state = "quoted"
        elif state == "begin" and c > " ":
            state = "plain"
        i += 1
    return state == "quoted"


def test_quotes_of_lines():
    assert not ends_inside('a,"b",c', False) and ends_inside('a,"b', False) and ends_inside('b""', True)
    assert not ends_inside('a"b,c', False) and not ends_inside('x"', True) and not ends_inside('"a"b "c', False)
    assert ends_inside('"a"b, "c', False) and not ends_inside("", False) and ends_inside("", True)
    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choice('",a ') for _ in range(rng.randrange(14)))
        for inside in (False, True):
            assert ends_inside(line, inside) == machine(line, inside), (line, inside)
    assert not ends_inside('"' + '""' * 200_000 + '"', False)  # long fields need no deep recursion


def odd_csv(rng, rows):
    """A file's text: quoted fields with line feeds, doubled quotes, text behind
    quotes, blank lines, short and long rows, LF and CR LF."""
    def field(k):
        kind = rng.randrange(9)
        word = f"{k}" + "".join(rng.choice("abç,") for _ in range(rng.randrange(5)))
        if kind < 3:
            return word.replace(",", ";")
        if kind == 3:
            return '"' + word + "\n\n" + word + "\n" * rng.randrange(60) + '"'
        if kind == 4:
            return f'"{word}""q"", ""\n"'
        if kind == 5:
            return f' "{word}" '
        if kind == 6:
            return f'"{k}"tail {k}'
        return '""' if kind == 7 else ""
    out = ["title,url,paper_number,doi"]
    for i in range(rows):
        out.append(",".join(field(i) for _ in range(rng.choice([4, 4, 4, 2, 6]))) or "x")
        if rng.random() < .1:
            out.append("")
    return "\n".join(out) + ("\n" if rng.random() < .5 else "")


def rows_of(df):
    got = [tuple(r) for r in df.drop("seen_at").orderBy("file_name", "row_no").collect()]
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_many_tasks_read_one_file_like_one(spark, scratch, small_blocks, seed):
    rng = random.Random(seed)
    os.makedirs(f"{scratch}/in put")
    for i in range(3):
        with open(f"{scratch}/in put/d{i} x.csv", "w", newline="") as f:
            f.write(odd_csv(rng, 60 if i else 0))
    split = {reject: rows_of(read_drops(spark, f"{scratch}/in put", True, reject)) for reject in (False, True)}
    parts = read_drops(spark, f"{scratch}/in put").select(F.spark_partition_id()).distinct().count()
    assert parts > 10
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, "64m")
    for reject in (False, True):
        one = rows_of(read_drops(spark, f"{scratch}/in put", True, reject))
        assert split[reject] == one and len(one) > 100
    # and like the CSV reader over whole files, row by row
    reader = spark.read.schema("title string, url string, paper_number string, doi string").option("multiLine", True) \
        .option("escape", '"').option("header", True).option("ignoreLeadingWhiteSpace", True) \
        .option("ignoreTrailingWhiteSpace", True).csv(f"{scratch}/in put")
    ours = read_drops(spark, f"{scratch}/in put").select("title", "url", "paper_number", "doi")
    assert sorted(map(str, ours.collect())) == sorted(map(str, reader.collect()))
    assert any(r["title"] and '"tail' in r["title"] for r in ours.collect())  # text behind quotes stays


def test_one_record_over_many_blocks(spark, scratch, small_blocks):
    body = "\n".join(f'line {i} ""' for i in range(100))
    with open(f"{scratch}/a.csv", "w") as f:
        f.write(f'title,url\n"{body}",u1\nt2,u2\n"never closed\n{body[:69]}')
    got = rows_of(read_drops(spark, scratch).select("file_name", "row_no", "seen_at", "title", "url"))
    text = body.replace('""', '"')
    assert [r[1:] for r in got] == [(1, text, "u1"), (2, "t2", "u2"), (3, ("never closed\n" + body[:69]).replace('""', '"'), None)]


def test_numbers_of_a_split_load(spark, scratch, small_blocks):
    os.makedirs(f"{scratch}/in")
    for name in "ab":
        with open(f"{scratch}/in/{name}.csv", "w") as f:
            f.write("paper_number,title\n" + "".join(f'{name}{i},"T\n{i}"\n' if i % 7 else f"{name}{i}\n" for i in range(120)))
    run_load(spark, f"{scratch}/in", f"{scratch}/papers", f"{scratch}/log", on_ragged="reject")
    papers = read_papers(spark, f"{scratch}/papers").orderBy("seq").collect()
    assert [(p.seq, p.paper_number) for p in papers] == list(
        enumerate([f"{n}{i}" for n in "ab" for i in range(120) if i % 7], 1))
    assert papers[0].title == "T\n1"


def test_summaries_hold_either_state(spark, scratch, small_blocks):
    with open(f"{scratch}/a.csv", "w") as f:
        f.write('h\n"a\nb"\n' + '"x\n' * 200 + '"\n')
    rows = block_summaries(lines_of(spark, scratch)).collect()
    states, parts = block_states(rows)
    assert len(states) == len(rows) > 2 and parts
    raw = read_records(spark, scratch, [f"{scratch}/a.csv"]).orderBy("row_no").collect()
    lines = open(f"{scratch}/a.csv").read().split("\n")
    assert "\n".join(r["raw"] for r in raw) == "\n".join(lines[:-1])
    assert block_states([]) == ({}, [])


def test_headers(spark, scratch):
    names = header_names(spark, ["a, B ,\"c,d\"", "one", ",".join(f"x{i}" for i in range(21_000))])
    assert names[0] == ["a", "b", "c,d"] and names[1] == ["one"] and len(names[2]) == 21_000 and names[2][-1] == "x20999"
    assert header_names(spark, []) == []
    with open(f"{scratch}/h.csv", "w", encoding="utf-8") as f:
        f.write('﻿\n\n"ti\ntle",url\n1,2\n')
    assert first_record(spark, f"{scratch}/h.csv") == '"ti\ntle",url'
    open(f"{scratch}/e.csv", "w").close()
    assert first_record(spark, f"{scratch}/e.csv") is None
    assert plain_name("file:///a/b") == plain_name("file:/a/b") and plain_name("a") == "a"


def test_files_under_many_headers(spark, scratch, monkeypatch):
    import quire.sources.drops as D
    monkeypatch.setattr(D, "HEADERS_PER_SCAN", 3)
    for i in range(8):
        with open(f"{scratch}/{i}.csv", "w") as f:
            f.write(",".join([f"x{k}" for k in range(i)] + ["title"]) + "\n" + "," * i + f"T{i}\n")
    got = clean_drops(spark, scratch).orderBy("file_name").collect()
    assert [r.title for r in got] == [f"T{i}" for i in range(8)]


def test_cluster_faults_are_no_file_faults(spark, scratch, monkeypatch):
    import quire.plans.load_run as LR
    with open(f"{scratch}/a.csv", "w") as f:
        f.write("title\nT\n")

    def broken(*a, **k):
        raise RuntimeError("no workers")
    monkeypatch.setattr(LR, "clean_drops", broken)
    monkeypatch.setattr(LR, "_check_workers", broken)
    with pytest.raises(RuntimeError, match="no workers"):
        run_load(spark, scratch, f"{scratch}/papers", f"{scratch}/log")
    monkeypatch.undo()
    LR._check_workers(spark)
