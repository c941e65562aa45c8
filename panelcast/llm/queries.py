"""One query for each operator, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import collocations, conversations, fm_index, host_rules, licenses, main_text, masked_lm, pieces, prefix_join, redirects, suffix_array, toxic_crf, winnowing
from panelcast.llm.sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.tokenise(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = main_text.main_text(pages, main_text.fit_pages(pages))
    return pages.withColumn("text", text).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fm_index.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.col("kept_sha").alias("kept_sha256"))


@query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept")


@query
def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that repeat a passage of 50 words or more of a document with a smaller id."""
    found = suffix_array.repeated_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed")


@query
def op5_suffix_array_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that go (start-end of each span, from 0, end exclusive) and what is left."""
    done = suffix_array.cut_documents(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x.start, x.end)), ",")
    return done.select("doc_id", "n_words", "n_removed", "copy_of", spans.alias("spans"), F.col("kept_sha").alias("kept_sha256"))


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.score(docs, masked_lm.train(docs)).drop("text")


@query
def op8_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxic_crf.fit_labels(docs, table(spark, sf_dir, "labels"))
    held = toxic_crf.held_out(F.col("doc_id")).alias("held_out")
    return toxic_crf.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = [
    redirects.Rule("allow", "org", "/"),
    redirects.Rule("block", "example.org", "/es/"),
    redirects.Rule("block", "example.org", "/en/1"),
    redirects.Rule("allow", "com", "/fr/"),
    redirects.Rule("block", "com", "/de/"),
]


@query
def op9_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.linked(table(spark, sf_dir, "documents"))


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined)


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(table(spark, sf_dir, "conversations"), damage=True)


QUERIES["pipeline"] = corpus_pipeline.run
