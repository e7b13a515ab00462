"""The similarity join against all pairs on small tables and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMOKE
from oracle_check import compare, duck
from quire.llm import queries as Q, set_join as S, sql
from quire.llm.hashing import word_hashes
from quire.llm import hashing
from quire.llm.set_join import Bands, Join, join_similar, node_numbers, shingle_sets, sketches

LONG = " ".join(f"w{i % 9973}" for i in range(120_000))


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_components(rows, percent=80):
    sets, link = plain_sets([t for _, t in rows]), list(range(len(rows)))

    def top(i):
        while link[i] != i:
            i = link[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                link[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(top(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)]


def by_text(rows):
    return sorted(map(str, rows))


def test_sets_of_shingles():
    texts = ["A b  c\td e f", None, "", " \n ", "x y", "X\ny", "x y z", "a a a a a a a a", "a b c d e", "0"]
    h, begin = shingle_sets(pa.array(texts))
    assert np.diff(begin).tolist() == [2, 0, 0, 0, 1, 1, 1, 1, 1, 1]
    sets = [frozenset(h[a:b].tolist()) for a, b in zip(begin, begin[1:])]
    assert sets[4] == sets[5] != sets[6] and sets[8] < sets[0]
    node = node_numbers(h, begin)
    assert node[4] == node[5] and len({int(x) for x in node[[0, 4, 6, 7, 8, 9]]}) == 6
    assert shingle_sets(pa.array([], pa.string()))[0].size == 0
    assert shingle_sets(pa.array([None], pa.string()))[1].tolist() == [0, 0]


def test_hashes_of_words_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(1)
    known = {}
    for chunk in (1, 3, 7, 50, 4 << 20):
        monkeypatch.setattr(hashing, "CHUNK", chunk)
        for _ in range(150):
            texts = [rng.choice([None, "".join(rng.choice("aB \n\té漢") for _ in range(rng.randrange(30)))])
                     for _ in range(rng.randrange(6))]
            h, begin = word_hashes(pa.array(["zz", *texts], pa.string()).slice(1))
            words = [(t or "").encode().lower().split() for t in texts]
            assert np.diff(begin).tolist() == [len(w) for w in words]
            assert all(known.setdefault(w, x) == x for w, x in zip(sum(words, []), h.tolist()))
    assert len(set(known.values())) == len(known) > 100


def test_similar_sets_share_a_signature_and_pass_the_sketch():
    rng, bands = random.Random(2), Bands()
    assert (bands.differ(bands.last, bands.last) < bands.parts).all()
    for trial in range(250):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 50, 130, 400])
        base = [rng.getrandbits(64) for _ in range(n)]
        lost = rng.randrange(n // 5 + 1)
        other = base[lost:] + [rng.getrandbits(64) for _ in range(rng.randrange(n // 5 + 2))]
        both = [sorted(set(base)), sorted(set(other))]
        common = len(set(base) & set(other))
        if 100 * common < 80 * len(set(base) | set(other)):
            continue
        h, begin = np.array(sum(both, []), np.uint64), np.cumsum([0, len(both[0]), len(both[1])])
        sig, owner = bands.signatures(h, begin)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (n, lost)
        for bits in (S.SKETCH, S.SHARP):
            s = sketches(h, begin, bits)
            assert s.shape == (2, bits // 64)
            assert np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum() <= len(set(base) ^ set(other))


def test_sets_with_many_empty_parts_still_meet():
    bands = Bands()
    rng = random.Random(8)
    met = 0
    for _ in range(3000):  # small sets: some have more than ``spare`` empty parts
        base = sorted(rng.getrandbits(64) for _ in range(5))
        h, begin = np.array(base + base[:4], np.uint64), np.array([0, 5, 9])
        sig, owner = bands.signatures(h, begin)
        met += bool(set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()))
    assert met == 3000


def test_node_table_answers_like_spark(spark):
    nodes = spark.range(-500, 500).select(F.col("id").alias("node"))
    got = S._in_table(S.node_table(nodes), np.arange(-500, 500))
    assert got.all()
    assert S._in_table(S.node_table(nodes), np.arange(10_000, 20_000)).mean() < .01
    assert not S.node_table(nodes.limit(0)).any()


def windows(rng, n=150):
    """Sets in chains: windows over one text, of many sizes, with changed words,
    and rows around one passage that all share."""
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(n):
        a, m = rng.randrange(300), rng.choice([1, 3, 5, 6, 8, 12, 25, 40, 90])
        w = words[a:a + m]
        if rng.random() < .4 and len(w) > 8:
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, passage + " " + " ".join(f"u{i}x{k}" for k in range(rng.randrange(12)))) for i in range(60)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3)])
def test_components_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = windows(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [tuple(r) for r in join_similar(df, keep=["doc_id"]).collect()]
    assert by_text(got) == by_text(plain_components(rows))


def test_reopened_signatures_connect_every_similar_pair(spark, monkeypatch):
    """Without any link known, the forest of each signature connects its similar
    pairs; pairs that failed are not given again."""
    for block in (2048, 4):
        monkeypatch.setattr(S, "BLOCK", block)
        rows = windows(random.Random(3))
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        join = Join(df, "text", 5, 80)
        marked = join.marked(["doc_id"]).where("node is not null").cache()
        nodes = marked.groupBy("node").agg(F.first("n_shingles").alias("size"), *(F.first(c).alias(c) for c in S.SKETCH_COLS))
        roots = spark.createDataFrame([], "node bigint, root bigint")
        _, members = join.candidates()
        pairs = {(r["a"], r["b"]) for r in join.reopened(members, nodes, roots, False).collect()}
        every = {(r["a"], r["b"]) for r in join.reopened(members, nodes, roots, True).collect()}
        assert pairs <= every
        top = {}

        def end(v):
            while top.get(v, v) != v:
                v = top[v]
            return v
        for a, b in pairs:
            top[end(a)] = end(b)
        node = {r["doc_id"]: r["node"] for r in marked.collect()}
        sets, count = plain_sets([t for _, t in rows]), 0
        per = {}  # signatures of three sets or more only are taken up
        h, begin = shingle_sets(pa.array([t for _, t in rows]))
        sig, owner = join.bands.signatures(h, begin)
        numbers = node_numbers(h, begin)
        for s, o in zip(sig.tolist(), owner.tolist()):
            per.setdefault(s, set()).add(int(numbers[o]))
        held = [v for v in per.values() if len(v) > 2]
        for i in range(len(rows)):
            for j in range(i):
                a, b = sorted((node[rows[i][0]], node[rows[j][0]]))
                if a != b and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) \
                        and any(a in v and b in v for v in held):
                    assert end(a) == end(b) and (a, b) in every
                    count += 1
        assert count > 20
        marked.unpersist()


def test_large_sets_around_one_passage_make_no_pairs(spark):
    """Sets of a thousand shingles and more share signatures by a long passage;
    the short sketch cannot tell them apart, so each pair was a row."""
    passage = " ".join(f"p{i}" for i in range(700))
    rows = [(i, passage + " " + " ".join(f"u{i}x{k}" for k in range(800))) for i in range(20)]
    join = Join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "text", 5, 80)
    marked = join.marked(["doc_id"])
    nodes = marked.select("node", F.col("n_shingles").alias("size"), *S.SKETCH_COLS, "sharp")
    members = join.candidates()[1].cache()
    roots = spark.createDataFrame([], "node bigint, root bigint")
    assert join.reopened(members, nodes.drop("sharp"), roots, True).count() > 100
    assert join.reopened(members, nodes, roots, True).count() == 0
    members.unpersist()


def test_forest_of_groups():
    g, a, b = np.array([1, 1, 1, 2, 2]), np.array([5, 6, 5, 5, 5]), np.array([6, 7, 7, 7, 7])
    assert S.forest_of(g, a, b) == [0, 1, 3] and S.forest_of(g[:0], a[:0], b[:0]) == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG + " end"), (6, "same text"), (6, "same text"),
            (None, "SAME\ttext"), (None, "lonely one"), (7, "a b c d e"), (8, "a b c d e f"), (9, "a b c d e f g h i j")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("N_shingles", "component_id", "node", "row", "id", "s0", "sig", "size"):
        df = df.withColumn(c, F.lit("clash"))
    out = join_similar(df)
    assert out.columns == ["doc_id", "text", "node", "row", "id", "s0", "sig", "size", "n_shingles", "component_id"]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()]
    assert by_text(got) == by_text(plain_components(rows))
    assert join_similar(df.limit(0)).count() == 0


def test_join_matches_sql(spark):
    res = compare(spark, duck(SMOKE), "op12", Q.op12_partenum_join, sql.SIMILAR, SMOKE)
    assert res["status"] == "match", res


def test_hash_of_a_long_is_sparks(spark):
    got = spark.range(3).select(F.xxhash64("id").alias("h")).collect()
    assert [r["h"] & (1 << 64) - 1 for r in got] == [xxhash.xxh64_intdigest(int(i).to_bytes(8, "little"), 42) for i in range(3)]
