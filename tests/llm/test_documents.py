"""Operators on documents against plain versions on small tables and odd rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMOKE
from quire.llm import queries as Q
from quire.llm.byte_cnn import CHUNK, ByteNet, Training, fit, gradients, in_fold, score_quality, train, training_chunks
from quire.llm.common import scratch, table
from quire.llm.decontaminate import Matcher, mark_contaminated
from quire.llm.hyper_language import SIZE, learn, letter_vectors, numbered, predict_language, symbol_table, trigrams
from quire.llm.line_quality import BOILERPLATE, clean_lines, judge, line_fault
from quire.llm.packing import (B, GRAM, K1, SHARE, SLACK, ByteBpe, cut_at_powers, default_files, fill, finished, neighbours,
                               pack, part_hashes, posting_lists, run_hashes, run_terms, scored_pairs, spark_hash, token_table)
from quire.llm.simhash import components, covering_masks, fingerprint, forest, near_edges, near_groups
from quire.llm.token_counts import PrefixCounts, count_tokens, default_model, longest_prefix, prefix_counts

LONG = "word and other words, " * 30_000
ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "Ä ü 漢字 🙂 x", "de"), (5, LONG, "en"),
       (6, "same text here, twice.", "en"), (6, "same text here, twice.", "en"), (None, "no id", "fr"),
       (7, "a  b\n\n c<|endoftext|> <s> \u2581 \x00 \x1c", None)]
SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns named like what operators make."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("Score", "n_words", "kept", "component_id", "simhash", "ids", "row", "key", "n_tokens", "x", "listed"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SMOKE, "documents").collect()]


# 1, line quality: the registered query is compared with its SQL below

def test_line_rules():
    assert line_fault(b"Home | News | Sport | Weather") == "navigation"
    assert line_fault(b"All Rights Reserved 2024") == "boilerplate"
    assert line_fault(b"a### b*** c$$$ d%%%.") == "punctuation"  # three of four words
    assert line_fault(b"a### b*** c d") == ""  # too few of them
    assert line_fault(b"BUY!! NOW!! CHEAP!!") == "punctuation"
    assert line_fault(b"w " * 60) == "punctuation"
    assert line_fault(b"A plain line, with marks.") == "" and line_fault(b" ") == ""


def test_long_lines_may_mention_a_phrase():
    words = iter(f"w{i}" for i in range(100_000))

    def clean(n):
        return " ".join(next(words) for _ in range(n)).capitalize() + ". "
    for phrase in BOILERPLATE:
        for mention in (f"They {phrase} there. ", clean(15)[:-2] + f" {phrase} " + clean(15)):
            text = clean(20) + clean(12) + mention + clean(18)
            assert line_fault(text.encode()) == "" and judge(text.encode())[6:8] == (0, True), text
    every = "".join(clean(14)[:-2] + f" {p} " + clean(10) for p in BOILERPLATE)
    assert judge(every.encode())[7] is True
    notice = "We use cookies on this site. Read our cookie policy here. Sign up for news. Terms of use apply to all visitors."
    assert len(notice.split()) > 20 and line_fault(notice.encode()) == "boilerplate"
    assert line_fault(("w " * 21 + "privacy policy " * 60 + ".").encode()) == "boilerplate"


def test_sql_judges_lines_like_the_operator():
    """Lines of many sentences that mention, and that consist of, phrases."""
    import duckdb
    import pandas as pd

    from quire.llm.sql import line_quality
    r = random.Random(4)
    words, ends = [f"w{i}" for i in range(300)], [". ", "! ", "… ", "。", "؟ ", ", ", "... ", " . ", "?? ", "……", "! . "]
    rows = []
    for i in range(700):
        lines = []
        for _ in range(r.randint(1, 4)):
            line = ""
            for _ in range(r.randint(1, 7)):
                s = r.sample(words, r.randint(1, 30))
                if r.random() < .5:
                    s.insert(r.randrange(len(s) + 1), r.choice(BOILERPLATE).title())
                line += " ".join(s) + r.choice(ends)
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    rows += [(9000, "One " + "word " * 70 + "with our privacy policy in it."), (9001, "Privacy policy. " * 30), (9002, "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {x[0]: x[1:] for x in con.execute(line_quality()).fetchall()}
    want = {i: judge(t.encode())[:8] for i, t in rows}
    assert got == {i: tuple(x) for i, x in want.items()}
    assert sum(0 < x[6] < x[1] for x in want.values()) > 100


def test_clean_lines_odd_rows(odd, none):
    got = clean_lines(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"] and by[1]["clean_text"] == ""
    assert by[5]["n_words"] == 120_000 and by[5]["base_failed"]  # repeats
    assert clean_lines(none).count() == 0
    good = "Here is a sentence, and more of it. " * 3 + " ".join(f"w{i}," for i in range(60))
    assert judge(good.encode())[7] is True
    bad = good + "\n" + " | ".join(f"link{i}" for i in range(400))
    assert judge(bad.encode())[7] is False


# 5, decontamination

def brute_hits(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def test_windows_of_all_lengths():
    r = random.Random(3)
    vocabulary = ["a", "b", "the", "Über", "x1", "longerword", "漢"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 2, 5, 13, 14, 30])))) for i in range(40)]
    docs = [" ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(60)]
    docs += [items[k][1].upper().replace(" ", r.choice([" ", ", ", "\n-"])) + " tail" for k in range(40)]
    docs += [None, "", "a" * 50_000]
    n_words, spans, found = Matcher([(i, t.encode()) for i, t in items]).search(
        [d.encode() if d is not None else None for d in docs])
    for k, d in enumerate(docs):
        n, h, ids = brute_hits(d, items)
        covered = {w for a, b in spans.get(k, []) for w in range(a, b)}
        assert (n_words[k], len(covered), sorted(map(str, found.get(k, ())))) == (n, h, ids), d


def test_contamination_in_blocks_and_odd_rows(spark, odd, none):
    docs, bench = table(spark, SMOKE, "documents"), table(spark, SMOKE, "benchmark")
    cols = ["doc_id", "n_words", "n_hit", "hit_items", "contaminated", "hit_spans"]
    one = mark_contaminated(docs, bench).select(cols).orderBy("doc_id").collect()
    many = mark_contaminated(docs, bench, block_bytes=500).select(cols).orderBy("doc_id").collect()
    assert one == many and any(r["contaminated"] for r in one)
    items = spark.createDataFrame([(1, "SAME text; here"), (None, "no id"), (2, None), (3, "...")],
                                  "item_id bigint, text string")
    by = {r["doc_id"]: r for r in mark_contaminated(odd, items).collect()}
    assert by[6]["n_hit"] == 3 and by[6]["hit_items"] == ["1"] and by[6]["contaminated"]
    assert by[None]["n_hit"] == 2 and by[None]["hit_items"] == []
    assert by[1]["n_words"] == 0 and not by[1]["contaminated"]
    assert mark_contaminated(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert mark_contaminated(none, items).count() == 0


# 8, SimHash

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs, radius=4):
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(pairs))]


def test_covering_masks_meet_every_pair():
    r = random.Random(5)
    masks = covering_masks(4)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 34 for m in masks)
    for _ in range(3000):
        flips = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(m & flips == 0 for m in masks)


def test_groups_match_brute_force(spark):
    rows = texts(spark)
    got = {r["doc_id"]: r for r in Q.op8_simhash_groups(spark, SMOKE).collect()}
    prints = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    for (d, p), c in zip(prints, brute_components(prints)):
        assert got[d]["fingerprint"] == f"{p:016x}" and got[d]["component_id"] == c


@pytest.mark.parametrize("bucket", [3, 50, 1 << 15])
def test_edges_keep_components_when_buckets_split(spark, bucket):
    r = random.Random(bucket)
    values = set()
    for _ in range(12):
        v = r.getrandbits(64)
        for _ in range(r.choice([1, 5, 40])):
            values.add(v)
            v ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 3, 4, 5, 9])))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "x bigint")
    got = {x["node"]: x["root"] for x in components(near_edges(df, bucket=bucket)).collect()}
    want = brute_components(list(zip(signed, values)))
    assert [got.get(v, v) for v in signed] == want


def test_forest_and_odd_rows(odd, none):
    a, b = forest(np.array([0, 15, 255, 1 << 40], np.uint64), 4)
    assert {frozenset(p) for p in zip(a, b)} == {frozenset((0, 1)), frozenset((1, 2)), frozenset((0, 3))}
    got = near_groups(odd).collect()
    assert len(got) == len(ODD)
    empty = {r["doc_id"]: r for r in got}
    assert empty[1]["component_id"] == empty[2]["component_id"] == empty[3]["component_id"] == 1
    assert empty[None]["component_id"] is None
    assert near_groups(none).count() == 0
    assert fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


# 2, packing

def test_ids_are_the_tokenizers(spark):
    bpe = ByteBpe(*default_files())
    cases = [t for _, t, _ in texts(spark)] + [t for _, t, _ in ODD if t and len(t) < 1000]
    r = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "don't", "é", "漢字", "<|endoftext|>", "12", "!!", "\u00a0", "\x1c", "🙂"]
    cases += ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(2000)]
    for t in cases:
        assert bpe.encode(t).tolist() == bpe.tokenizer.encode(t, add_special_tokens=False).ids


def check_packing(rows, want):
    """Every id of every document once, gapless sequences, little padding."""
    seqs, docs = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        seqs.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    pad = total = 0
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0] + [r["length"] for r in s[:-1]]))
        n = sum(r["length"] for r in s)
        assert n <= 1024
        total += n
        pad += 0 if n & (n - 1) == 0 else 1024 - n
    assert pad <= .02 * total + SLACK
    got = sorted((str(d), b"".join(r["ids"] for r in sorted(p, key=lambda r: r["start"]))) for d, p in docs.items())
    assert got == sorted(want)


def test_pack_round_trip(spark, odd, none):
    bpe, end = ByteBpe(*default_files()), b"\0\0\0\0"
    want = [(str(d), bpe.encode(t or "").tobytes() + end) for d, t, _ in texts(spark)]
    check_packing(pack(table(spark, SMOKE, "documents")).collect(), want)
    unique = odd.where("doc_id <> 6 or doc_id is null")
    check_packing(pack(unique).collect(), [(str(d), bpe.encode(t or "").tobytes() + end) for d, t, _ in ODD if d != 6])
    assert pack(odd.where("doc_id = 6")).agg(F.sum("length")).first()[0] == 2 * (len(bpe.encode(ODD[5][1])) + 1)
    assert pack(none).count() == 0


def test_digests_of_pieces(spark):
    bpe = ByteBpe(*default_files())
    ids = {d: np.append(bpe.encode(t or ""), 0).astype("<u4") for d, t, _ in texts(spark)}
    for r in Q.op2_retrieval_packing(spark, SMOKE).collect():
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


def plain_terms(ids):
    runs = [tuple(ids[i:i + GRAM]) for i in range(max(1, len(ids) - GRAM + 1))] if len(ids) else []
    return runs


def test_terms_of_documents():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 4, n) for n in (0, 1, 5, 6, 7, 400, 0, 30)]
    begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    terms, counts, at = run_terms(np.concatenate(docs), begin, share=1)
    number = {}
    for i, d in enumerate(docs):
        runs = plain_terms(d.tolist())
        assert counts[at[i]:at[i + 1]].sum() == len(runs) and at[i + 1] - at[i] == len(set(runs))
        alone, n, _ = run_terms(d, np.array([0, len(d)]), share=1)
        assert alone.tolist() == terms[at[i]:at[i + 1]].tolist() == sorted(alone.tolist(), key=lambda x: x % (1 << 64))
        for run in set(runs):
            h = run_terms(np.array(run), np.array([0, len(run)]), share=1)[0][0]
            assert number.setdefault(run, h) == h and n[alone.tolist().index(h)] == runs.count(run)
    assert len(set(number.values())) == len(number)
    held = run_terms(np.concatenate(docs), begin)[0]
    assert set(held.tolist()) == {t for t in terms.tolist() if t % (1 << 64) % SHARE == 0}


def test_windows_are_filled_greedily():
    assert fill(100, [(1, 60), (2, 50), (3, 40), (4, 30)]) == [(1, 60), (3, 40)]
    assert fill(100, [(1, 60), (2, 50), (4, 30)]) == [(1, 60), (4, 30), (2, 10)]
    assert fill(100, [(1, 130)]) == [(1, 100)] and fill(100, []) == [] and fill(5, [(1, 2)]) == [(1, 2)]


def test_open_windows_and_loose_pieces():
    r = random.Random(5)
    for opens, looses in ((0, 0), (0, 9), (9, 0), (5, 40), (40, 5), (1, 1)):
        opened = [[(i, 0, r.randint(1, 500)), (1000 + i, 3, r.randint(1, 500))] for i in range(opens)]
        loose = [(2000 + i, r.choice([0, 7]), r.randint(1, 1023)) for i in range(looses)]
        done = finished(opened, loose, 1024)
        ids = sorted((d, i) for s in done for d, a, n in s for i in range(a, a + n))
        assert ids == sorted((d, i) for s in [*opened, loose] for d, a, n in s for i in range(a, a + n))
        sizes = [sum(n for _, _, n in s) for s in done]
        assert all(n == 1024 or n & (n - 1) == 0 or i == len(sizes) - 1 for i, n in enumerate(sizes))
        assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) <= SLACK + sum(n < 1024 for n in sizes[-1:]) * 1024


def test_neighbours_against_brute_force(spark):
    """BM25 over all rows with the index's terms, each pair scored plainly."""
    r = random.Random(9)
    base = [" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(12)]
    rows = [(i, base[i % 12][r.randrange(200):][:r.randint(150, 400)]) for i in range(40)] + [(90, ""), (91, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    tokens, kind = token_table(df, "doc_id", "text", *default_files(), 1024)
    docs = {x["row"]: x for x in tokens.collect()}
    mean = sum(x["size"] for x in docs.values()) / len(docs)
    found = {k: {t for t in x["terms"]} for k, x in docs.items()}
    for k, x in docs.items():
        ids = np.frombuffer(x["ids"], kind)
        t, c, _ = run_terms(ids, np.array([0, len(ids)]))
        assert (x["terms"], x["counts"]) == (t.tolist(), c.tolist()) and x["rest"] == len(ids) % 1024
    df_of = {t: sum(t in f for f in found.values()) for f in found.values() for t in f}
    got = {}
    for x in neighbours(tokens, tokens.select("row"), 1000).collect():
        got.setdefault(x["seed"], {})[x["cand"]] = x["score"]
    pairs = 0
    for a in docs:
        want = {}
        for b, x in docs.items():
            for t in found[a] & found[b] if a != b else ():
                tf = x["counts"][x["terms"].index(t)]
                idf = np.log(1 + (len(docs) - df_of[t] + .5) / (df_of[t] + .5))
                want[b] = want.get(b, 0) + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * x["size"] / mean))
        assert set(want) == set(got.get(a, {}))
        assert all(abs(want[b] - got[a][b]) < 1e-4 for b in want)
        pairs += len(want)
    assert pairs > 60
    top = neighbours(tokens, tokens.select("row"), 1).collect()
    assert all(abs(x["score"] - max(got[x["seed"]].values())) < 1e-9 for x in top) and len(top) == len(got)


def test_short_common_passages_are_found(spark):
    """Two documents that share nothing but a dozen words are neighbours."""
    r = random.Random(17)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows = []
    for k in range(30):
        passage = [word() for _ in range(12)]
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    tokens, _ = token_table(df, "doc_id", "text", *default_files(), 1024)
    name = {x["row"]: x["doc_id"] for x in tokens.select("row", "doc_id").collect()}
    best = {name[x["seed"]]: name[x["cand"]] for x in neighbours(tokens, tokens.select("row"), 1).collect()}
    assert best == {i: i ^ 1 for i in range(60)}


def test_long_posting_lists_go_in_ranges(spark, monkeypatch):
    import quire.llm.packing as P
    monkeypatch.setattr(P, "RANGE", 64)
    text = " ".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=200))
    df = spark.createDataFrame([(i, text) for i in range(500)], "doc_id bigint, text string").repartition(4)
    tokens, _ = token_table(df, "doc_id", "text", *default_files(), 1024)
    postings = posting_lists(tokens)
    sizes = [x["count"] for x in postings.groupBy("term", "block").count().collect()]
    assert sum(sizes) == postings.count() and max(sizes) <= 110 and postings.select("block").distinct().count() == 8
    asks = F.pmod(F.xxhash64("row"), F.lit(3)) == 0
    pairs = scored_pairs(postings, asks, ~asks)
    met = pairs.select("cand").distinct().count()  # all but a few at the ends of ranges meet a seed
    assert met >= .95 * tokens.where(~asks).count()
    assert pairs.groupBy("cand").count().agg(F.max("count")).first()[0] <= 31 * len(tokens.first()["terms"])


def test_postings_are_shuffled_in_parts(spark, monkeypatch):
    """Parts hold whole lists, no part most of them, and pairs come out as from one part."""
    import quire.llm.packing as P
    r = random.Random(11)
    base = [" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(4)]
    df = spark.createDataFrame([(i, base[i % 4][r.randrange(100):]) for i in range(16)], "doc_id bigint, text string").repartition(2)
    tokens, _ = token_table(df, "doc_id", "text", *default_files(), 1024)
    tokens = tokens.persist()
    lists = lambda x: sorted(tuple(r) for r in x.collect())
    whole, parts = lists(posting_lists(tokens)), [lists(posting_lists(tokens, k, 4)) for k in range(4)]
    assert sorted(x for p in parts for x in p) == whole and max(map(len, parts)) < len(whole) / 2
    plain = lists(neighbours(tokens, tokens.select("row"), 1000))
    monkeypatch.setattr(P, "PART_IDS", 1)
    monkeypatch.setattr(P, "PARTS", 4)
    monkeypatch.setattr(P, "HELD", 50)
    in_parts = lists(neighbours(tokens, tokens.select("row"), 1000))
    assert [x[:2] for x in in_parts] == [x[:2] for x in plain] and len(plain) > 16
    assert np.allclose([x[2] for x in in_parts], [x[2] for x in plain])


def test_sums_of_pairs_are_added_again(spark, monkeypatch):
    """Pairs are summed several times in a task, first those of some batches, then with further ones."""
    import quire.llm.packing as P
    df = spark.createDataFrame([(t, 0, r, r, 1.0) for t in range(300) for r in range(8)],
                               "term bigint, block bigint, mark bigint, row bigint, weight float").coalesce(1)
    monkeypatch.setattr(P, "HELD", 500)
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("100", "1")):
        spark.conf.set(k, v)
    try:
        got = {(x["seed"], x["cand"]): x["score"] for x in scored_pairs(df, F.lit(True), F.lit(True)).collect()}
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert got == {(a, b): 300.0 for a in range(8) for b in range(8) if a != b}


def test_hashes_of_parts_are_those_of_all_runs():
    r = np.random.default_rng(4)
    for sizes in ((1,), (5, 3), (6,), (0, 1, 5, 6, 7, 400, 0, 30, 2), (2, 900)):
        docs = [r.integers(0, 9, n).astype("<u2") for n in sizes]
        ids, begin = np.concatenate(docs), np.concatenate([[0], np.cumsum(sizes)])
        h, n = run_hashes(ids, begin)
        want = sorted(zip(np.repeat(np.arange(len(sizes)), n).tolist(), h.tolist()))
        for parts in (1, 2, 8):
            got, terms = [], []
            for part in range(parts):
                h, at = part_hashes(ids, begin, part, parts)
                got += zip(np.repeat(np.arange(len(sizes)), np.diff(at)).tolist(), h.tolist())
                terms.append(set(h.tolist()))
            assert sorted(got) == want and sum(map(len, terms)) == len(set.union(*terms))


def test_blocks_are_those_of_the_rows_hash(spark):
    values = [0, 1, -1, 5 << 40, (7 << 40) + 123456, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", F.xxhash64("v").alias("h"))
    assert all(spark_hash(np.array([x["v"]], np.int64))[0] == x["h"] for x in df.collect())


def test_long_lists_of_a_bucket_are_handed_on(spark, monkeypatch):
    """Pairs are the same when a task holds few runs; sums of earlier parts are held once."""
    import quire.llm.packing as P
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join([*words[:40], *r.choices(words, k=30)])) for i in range(60)],
                               "doc_id bigint, text string").repartition(12)
    tokens, _ = token_table(df, "doc_id", "text", *default_files(), 1024)
    tokens = tokens.persist()
    pairs = lambda: sorted(tuple(x) for x in neighbours(tokens, tokens.select("row"), 1000).collect())
    plain = pairs()
    for name, value in (("FULL", 200), ("HELD", 50), ("PART_IDS", 1), ("PARTS", 4), ("BUCKET", 1500)):
        monkeypatch.setattr(P, name, value)
    made, met, long = [], P.met_cells, P.long_pairs
    root = os.path.dirname(scratch(spark, "x"))
    before = set(os.listdir(root))
    monkeypatch.setattr(P, "long_pairs", lambda *a: made.append("long") or long(*a))

    def watched(*a):
        out = met(*a)
        made.append([x.split("-")[0] for x in set(os.listdir(root)) - before])
        return out
    monkeypatch.setattr(P, "met_cells", watched)
    in_parts = pairs()
    assert "long" in made and [x[:2] for x in in_parts] == [x[:2] for x in plain] and len(plain) > 1000
    assert np.allclose([x[2] for x in in_parts], [x[2] for x in plain])
    parts = [x for x in made if x != "long"]
    assert len(parts) == 4 and all(x.count("met") == 1 and x.count("sums") <= 1 for x in parts)


def test_every_pair_of_a_long_list_is_scored(spark, monkeypatch):
    """All documents of a passage meet, in one cell or in many, with the sums that plain rows give."""
    import quire.llm.packing as P
    r = random.Random(31)
    passage = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8))
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    df = spark.createDataFrame([(i, " ".join([*(word() for _ in range(10)), passage, word()])) for i in range(150)],
                               "doc_id bigint, text string").repartition(5)
    tokens, _ = token_table(df, "doc_id", "text", *default_files(), 1024)
    tokens = tokens.persist()
    want = {(x["seed"], x["cand"]): x["score"] for x in scored_pairs(posting_lists(tokens), F.lit(True), F.lit(True)).collect()}
    assert len(want) == 150 * 149
    for values in ({}, {"CELL_POSTS": 700, "DEALT": 4000, "DENSE": 500, "SHORT": 2}):
        for name, value in values.items():
            monkeypatch.setattr(P, name, value)
        got = {(x["seed"], x["cand"]): x["score"] for x in neighbours(tokens, tokens.select("row"), 1000).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_candidates_look_beyond_the_best_they_were_given(spark, monkeypatch):
    """Windows are filled alike when a candidate gets one seed at a time."""
    import quire.llm.packing as P
    r = random.Random(33)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(120)]
    rows = [(i, " ".join(words[(j := r.randrange(60)):j + r.randint(20, 60)])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    tokens, _ = P.id_table(df, "doc_id", "text", *default_files(), 256)
    made, asked, best = [], [], P.best_of
    monkeypatch.setattr(P, "best_of", lambda *a: asked.append(len(a)) or best(*a))
    for top, least in ((1000, 0.), (1, 1.)):
        monkeypatch.setattr(P, "TOP", top)
        monkeypatch.setattr(P, "LEAST", least)
        made.append(sorted((x["row"], x["seed"], x["length"]) for x in P.seeded_windows(tokens, 256)[0].collect()))
    assert made[0] == made[1] and len(made[0]) > 20
    assert asked[0] == 4 and 5 in asked[1:]  # asked again only where the given seeds ran out


def test_lots_are_the_hashes_of_both_rows(spark):
    r = np.random.default_rng(2)
    values = [(int(a), int(b)) for a, b in r.integers(-(1 << 62), 1 << 62, (50, 2))]
    df = spark.createDataFrame(values, "v bigint, w bigint").withColumn("h", F.xxhash64("v", "w"))
    v, w, h = (np.array(x, np.int64) for x in zip(*df.collect()))
    assert (spark_hash(w, spark_hash(v)) == h).all()


def test_tasks_of_the_index_are_handed_small_batches(spark, monkeypatch):
    import quire.llm.packing as P
    monkeypatch.setattr(P, "BATCH", 20_000)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
    big = spark.createDataFrame([(bytes(5000),)] * 64, "x binary").coalesce(1)
    got = [x["n"] for x in P.held_as(big.mapInArrow(sizes, "n bigint"), "x").collect()]
    assert len(got) > 8 and max(got) < 40_000 and spark.conf.get(name, None) == before


def test_copies_share_windows_across_partitions(spark):
    r = random.Random(7)
    topics = [[f"{a}{b}" for a in r.sample("bcdfghjklmnpqrstvwxz", 6) for b in r.sample("aeiouy", 5)] for _ in range(24)]
    rows = [(t, " ".join(r.choices(topics[t], k=300))) for t in range(24)]
    rows += [(100 + 30 * k + t, " ".join(rows[t][1].split()[k:240])) for t in range(24) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartitionByRange(4, "doc_id")
    seqs = {}
    for x in pack(df).collect():
        seqs.setdefault(x["sequence_id"], []).append(x["doc_id"] if x["doc_id"] < 100 else (x["doc_id"] - 100) % 30)
    seeded = [s for n, s in seqs.items() if n < 1 << 60 and len(s) > 1]
    alike = sum(len(set(s)) == 1 for s in seeded)
    assert alike >= .8 * len(seeded) and alike >= 8  # windows that seeds filled hold their own copies


def test_cut_at_powers():
    for n in (1, 700, 1000, 1023):
        cut = cut_at_powers([(0, 0, n // 2), (1, 5, n - n // 2)], 1024)
        sizes = [sum(x for _, _, x in s) for s in cut]
        assert sum(sizes) == n and all(x & (x - 1) == 0 for x in sizes[:-1])


# 7, token counts

def test_counts_at_every_prefix():
    pc = PrefixCounts(default_model())
    r = random.Random(1)
    parts = ["the", "a", " ", "  ", "\n", "ü", "漢字", "<s>", "\u2581", "é", "ing", "Und", "🙂", "\x00", "12", "..."]
    for t in ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(400)] + [ODD[7][1], ODD[8][1]]:
        c = prefix_counts(pc.text_steps(t))
        assert c.tolist() == [len(pc.sp.encode(t[:k])) for k in range(len(t) + 1)]


def test_token_counts_match_the_library(spark, odd, none):
    pc = PrefixCounts(default_model())
    want = {d: len(pc.sp.encode(t or "")) for d, t, _ in texts(spark)}
    for r in Q.op7_token_counts(spark, SMOKE).collect():
        assert r["n_tokens"] == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 4096)
    got = count_tokens(odd, limit=20, store=True).collect()
    assert len(got) == len(ODD)
    for r in got:
        t = r["text"] or ""
        assert r["n_tokens"] == len(pc.sp.encode(t)) and r["n_bytes"] == len(t.encode())
        assert longest_prefix(r["prefix_steps"], 20) == r["fit_chars"]
        assert len(pc.sp.encode(t[:r["fit_chars"]])) <= 20
    assert count_tokens(none).count() == 0


def test_text_without_spaces_is_linear():
    pc = PrefixCounts(default_model())
    t = "ab漢c" * 5000
    assert prefix_counts(pc.text_steps(t))[-1] == len(pc.sp.encode(t))


# 6, language

def test_trigrams_of_letters():
    letters, owner = trigrams(["Ab1c", None, "é"], symbol_table())
    a, b, c, e = map(ord, "abcé")
    assert letters.T.tolist() == [[0, a, b], [a, b, 0], [0, c, 0], [0, e, 0]] and owner.tolist() == [0, 0, 0, 2]
    r = np.random.default_rng(2)
    for kinds in (3, 400):  # numbered by a table and by sorting
        x = r.integers(0, kinds, (3, 500)) * 7
        codes, place = numbered(x)
        assert (codes[place] == (x[0] << 42 | x[1] << 21 | x[2])).all() and len(set(codes.tolist())) == len(codes)


def plain_vector(text, size=SIZE):
    """Bind and bundle letter by letter."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    letter = {c: letter_vectors(np.array([ord(c) if c else 0]), size)[0].astype(int) for c in {"", *"".join(words)}}
    v = np.zeros(size)
    for w in words:
        x = ["", *w, ""]
        for p, q, r in zip(x, x[1:], x[2:]):
            v += np.roll(letter[p], 2) * np.roll(letter[q], 1) * letter[r]
    return v


def test_languages_against_plain_vectors(spark, monkeypatch):
    import quire.llm.hyper_language as H
    rows = [(i, t, lang) for i, (t, lang) in enumerate([
        ("the cat and the dog", "en"), ("das haus und der hund", "de"), ("猫 と 犬 が いる", "ja"), ("кот и собака", "ru"),
        ("and the house", "en"), ("犬 が いる", None), ("собака", None), ("42 !", None), (None, "en"), ("hund der 𝒶𝒷", "de")])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    protos = learn(df)
    want = {}
    for _, t, lang in rows:
        if lang:
            want[lang] = want.get(lang, 0) + plain_vector(t)
    assert sorted(want) == list(protos)
    want = {k: v / np.linalg.norm(v) for k, v in want.items()}
    assert all(np.allclose(protos[k], want[k], atol=1e-6) for k in want)
    for block in (H.BLOCK, 4):  # texts and their trigrams in parts
        monkeypatch.setattr(H, "BLOCK", block)
        got = H.text_vectors([t for _, t, _ in rows], symbol_table())
        assert np.allclose(got, [plain_vector(t) for _, t, _ in rows])
    for r, (_, t, _) in zip(predict_language(df, protos).orderBy("doc_id").collect(), rows):
        v = plain_vector(t)
        cos = {k: v @ p / np.linalg.norm(v) for k, p in want.items()} if v.any() else {"und": 0.0}
        assert r["lang_pred"] == max(sorted(cos), key=cos.get) and abs(r["score"] - max(0, max(cos.values()))) < 1e-6


def test_short_texts_of_other_scripts(spark):
    r = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    r.shuffle(letters)
    lists = {f"l{k}": ["".join(r.choices(letters, k=r.randint(1, 3))) for _ in range(400)] for k in range(3)}
    make = lambda k, n: " ".join(r.choices(lists[k], k=n))
    train = spark.createDataFrame([(make(k, 200), k) for k in lists for _ in range(40)], "text string, lang string")
    rows = [(make(k, 6), k) for k in lists for _ in range(100)]
    got = predict_language(spark.createDataFrame(rows, "text string, lang string"), learn(train)).collect()
    assert np.mean([x["lang_pred"] == x["lang"] for x in got]) >= .95


def test_held_out_languages(spark, odd, none):
    got = Q.op6_hyper_language(spark, SMOKE).collect()
    truth = {d: lang for d, _, lang in texts(spark)}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == in_fold(r["doc_id"], 4, 2) for r in got) and held
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > .95
    assert all(0 <= r["score"] <= 1 for r in got)
    protos = learn(table(spark, SMOKE, "documents"))
    by = {r["doc_id"]: r["lang_pred"] for r in predict_language(odd, protos).collect()}
    assert by[1] == by[2] == by[3] == "und" and by[5] in protos
    assert {r["lang_pred"] for r in predict_language(odd, learn(none)).collect()} == {"und"}
    assert predict_language(none, protos).count() == 0


# 9, quality classifier

def plain_logit(w, text):
    """Every filter at every place of every chunk, then the dense layer."""
    width, _, filters = w["k"].shape
    step, t = CHUNK - width + 1, text or b""
    chunks = max(1, -(-(len(t) - width + 1) // step))
    t = t.ljust(chunks * step + width - 1, b"\0")
    logits = []
    for c in range(chunks):
        x = t[c * step:c * step + CHUNK]
        pooled = np.full(filters, -np.inf)
        for i in range(step):
            pooled = np.maximum(pooled, sum(w["e"][x[i + j]] @ w["k"][j] for j in range(width)))
        logits.append(np.clip(np.tanh(pooled @ w["d1"] + w["b1"]) @ w["d2"] + w["b2"][0], -8, 8))
    return float(np.mean(logits))


def small_weights(seed=3, filters=4, width=3, embedding=3, hidden=5):
    r = np.random.default_rng(seed)
    return {"e": r.normal(0, .5, (256, embedding)), "k": r.normal(0, .5, (width, embedding, filters)),
            "d1": r.normal(0, .5, (filters, hidden)), "b1": r.normal(0, .5, hidden), "d2": r.normal(0, .5, hidden), "b2": np.array([.1])}


def test_network_against_plain_convolution():
    w = small_weights()
    r = np.random.default_rng(4)
    texts = [None, b"", b"a", b"x" * 253, b"x" * 254, b"y" * 256, *(r.integers(0, 256, n, np.uint8).tobytes() for n in (255, 600, 1500, 70))]
    net = ByteNet({k: v.astype(np.float32) for k, v in w.items()})
    want = [plain_logit(w, t) for t in texts]
    for block in (1 << 17, 300, 600):
        assert np.allclose(net.logits(texts, block), want, atol=1e-4)
    assert b"".join(training_chunks(b"ab" * 1000))[:2000] == b"ab" * 1000 and training_chunks(None) == [bytes(CHUNK)]


def test_gradient_against_differences():
    w = small_weights()
    r = np.random.default_rng(6)
    x = r.integers(0, 256, (5, CHUNK), np.uint8)
    y, share = np.array([0, 1, 1, 0, 1.]), r.random(5)
    _, g = gradients(w, x, y, share)
    for k, v in w.items():
        for at in [tuple(r.integers(0, n) for n in v.shape) for _ in range(6)] + ([(int(x[0, 9]), 1)] if k == "e" else []):
            near = []
            for d in (1e-4, -1e-4):
                moved = {n: a.copy() for n, a in w.items()}
                moved[k][at] += d
                near.append(exact_loss(moved, x, y, share))
            assert abs((near[0] - near[1]) / 2e-4 - g[k][at]) < 1e-3, (k, at)


def exact_loss(w, x, y, share):
    z = np.array([plain_chunk(w, c) for c in x])
    return float((share * (np.logaddexp(0, z) - y * z)).sum())


def plain_chunk(w, c):
    width = w["k"].shape[0]
    pooled = np.max([sum(w["e"][c[i + j]] @ w["k"][j] for j in range(width)) for i in range(CHUNK - width + 1)], axis=0)
    return np.tanh(pooled @ w["d1"] + w["b1"]) @ w["d2"] + w["b2"][0]


def test_network_learns_and_covers_every_byte():
    r = np.random.default_rng(0)
    x = np.array([[97 + i % 2] * CHUNK for i in range(64)], np.uint8) + r.integers(0, 1, (64, CHUNK)).astype(np.uint8)
    net = fit(x, np.arange(64) % 2, np.ones(64), Training(epochs=20, batch=16))
    assert net.scores([b"b" * 3000])[0] > .9 and net.scores([b"a" * 3000])[0] < .1
    base = net.logits([b"a" * 5000])[0]
    assert all(net.logits([b"a" * k + b"b" * 8 + b"a" * (4992 - k)])[0] != base for k in (0, 251, 2500, 4992))
    many = [b"a" * n for n in (0, 1, 5, 250, 256, 257, 300_000)] + [None]
    assert np.allclose(net.logits(many), [net.logits([t])[0] for t in many], atol=1e-5)


def test_repeated_rows_are_learnt_once(spark):
    rows = [(i, ("good text " if i % 2 else "bad!!! ") * 30) for i in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    few = Training(epochs=1, rows=8)
    once = train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, settings=few)
    twice = train(spark.createDataFrame(rows + rows[:7] * 3, "doc_id bigint, text string"), labels, settings=few)
    assert all((once.w[k] == twice.w[k]).all() for k in once.w)


def test_held_out_quality(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    got = Q.op9_byte_cnn(spark, sf).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > .9
    assert all(r["predicted"] == (r["score"] >= .5) and 0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert train(odd, labels) is None
    assert {r["score"] for r in score_quality(odd, None).collect()} == {.5}
    net = ByteNet(fit(np.zeros((4, CHUNK), np.uint8), np.array([0, 1, 0, 1]), np.ones(4), Training(epochs=1)).w)
    assert score_quality(odd, net).count() == len(ODD) and score_quality(none, net).count() == 0


def test_item_digest_of_nothing(spark):
    none_hit = [r for r in Q.op5_decontaminate(spark, SMOKE).collect() if not r["n_items"]]
    assert none_hit and {r["items_sha256"] for r in none_hit} == {hashlib.sha256(b"").hexdigest()}
