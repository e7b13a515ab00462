"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import sql
from quire.llm.byte_cnn import score_quality, train
from quire.llm.common import fold, stored, table
from quire.llm.decontaminate import mark_contaminated
from quire.llm.host_paths import extract_pages
from quire.llm.hyper_language import learn, predict_language, training_rows
from quire.llm.line_quality import clean_lines
from quire.llm.packing import pack
from quire.llm.registry import register
from quire.llm.reply_trees import chain, format_branches, read_loss, read_turns
from quire.llm.set_join import join_similar
from quire.llm.shared_search import rank_documents
from quire.llm.simhash import near_groups
from quire.llm.token_counts import count_tokens
from quire.llm.url_filter import host, judge_urls, path
from quire.llm.word_runs import find_runs

#: Fixed by the contract: (verdict, host/path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]
#: Stand-in for a list of keys: those whose md5 begins with one of these digits.
LISTED_DIGITS = "012"


@register("op1_line_quality", sql.line_quality())
def op1_line_quality(spark, sf_dir):
    return clean_lines(table(spark, sf_dir, "documents"), keep=["doc_id"], clean_col=None)


@register("op2_retrieval_packing")
def op2_retrieval_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op3_reply_trees", sql.CHAT)
def op3_reply_trees(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    rows = rows.unionByName(fixed).withColumns({"role": F.coalesce("role", F.lit("")),
                                                "text": F.coalesce("text", F.lit(""))})
    messages = chain(rows, "conv_id", ["turn", "role", "text"])
    out = stored(format_branches(messages, tree_col="conv_id"), "formatted").select(
        F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                      F.sha2(said_all, 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))


@register("op4_host_paths")
def op4_host_paths(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@register("op5_decontaminate", sql.CONTAMINATION)
def op5_decontaminate(spark, sf_dir):
    marked = mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                               keep=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


@register("op6_hyper_language")
def op6_hyper_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(training_rows(docs))
    return predict_language(docs, prototypes, keep=["doc_id"]).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"])


@register("op8_simhash_groups")
def op8_simhash_groups(spark, sf_dir):
    groups = near_groups(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return groups.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"),
                         "component_id")


@register("op9_byte_cnn")
def op9_byte_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net, keep=["doc_id"]).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@register("op10_bloom_cascade", sql.url_verdicts(URL_RULES, LISTED_DIGITS))
def op10_bloom_cascade(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    keys = pages.select(F.concat(host(F.col("url")), path(F.col("url"))).alias("key"))
    listed = keys.where(F.instr(F.lit(LISTED_DIGITS), F.substring(F.md5(F.col("key")), 1, 1)) > 0).distinct()
    return judge_urls(pages, listed, URL_RULES, keep=["page_id"])


def looped(docs):
    """The documents with planted runs: of those whose id's crc32 ends in 0 the
    words from a certain one on are the period there, repeated."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = (docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), (h % 10 == 0).alias("hit"))
              .withColumn("w", F.when(F.col("hit"), words)).withColumn("n", F.size("w"))
              .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
              .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    copies = F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), F.col("n") - F.col("a")))
    return picked.select("doc_id", F.when(F.col("hit") & (F.col("n") > 0), F.array_join(made, " "))
                         .otherwise(F.col("text")).alias("text"))


@register("op11_word_runs")
def op11_word_runs(spark, sf_dir):
    found = find_runs(looped(table(spark, sf_dir, "documents")), keep=["doc_id"])
    # greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op12_partenum_join", sql.SIMILAR)
def op12_partenum_join(spark, sf_dir):
    return join_similar(table(spark, sf_dir, "documents"), keep=["doc_id"])


@register("op13_shared_search", sql.RANKED)
def op13_shared_search(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
