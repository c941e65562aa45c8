"""Quality rules of documents with verdicts by host, all in DataFrame functions.

Each document is counted and judged by a base rule. A host's failures of each host rule are summed; its
rate is shrunken towards the corpus with a beta prior that is fitted to all hosts' rates by moments; a
host fails if a shrunken rate is over the limit. The host's verdict goes back to its documents.

A null text has no words and fails the base rule. A null host is one host of its own. Repeated rows are
judged and counted one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.stage import BLANK, keep, let, split_words

MIN_WORDS = 50
#: Per cent of words in repeated three-word windows above which a document fails.
REPEAT_PERCENT = 50
#: A host fails if a shrunken failure rate is over this.
HOST_LIMIT = 0.5


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that a text has twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

    def covered(t: Column) -> Column:
        ordered = F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def found(s: Column) -> Column:
            twin = lambda e, k: F.coalesce(e.x == F.get(s, k - 1).x, F.lit(False)) | F.coalesce(e.x == F.get(s, k + 1).x, F.lit(False))
            at = F.transform(F.filter(s, twin), lambda e: F.array(e.i, e.i + 1, e.i + 2))
            return F.size(F.array_distinct(F.flatten(at)))

        return F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(let(ordered, found))

    return F.when(F.size(words) < 3, 0).otherwise(let(let(hashes, windows), covered))


def _word_counts(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
    )


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and counts of each document (all long)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return docs.select(
        "doc_id",
        F.col("source").alias("host"),
        let(split_words(F.col("text")), _word_counts).alias("c"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", "c.*", "word_chars", "n_symbols", "n_dup_lines")


def host_rules() -> dict[str, Column]:
    """The rules that hosts are judged by, each a condition on a document's counts."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": F.col("n_symbols") > F.col("n_words"),
        "lines": F.col("n_dup_lines") * 10 > F.col("n_words"),
    }


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each host: documents, failures and shrunken rate by rule, and host_kept.

    The prior beta(a, b) has the mean m and the variance v of the hosts' rates, with a + b = m(1-m)/v - 1.
    Hosts that all have one rate say that hosts don't differ: then each rate is the mean.
    """
    rules = host_rules()
    fails = [F.sum(rule.cast("long")).alias(f"fail_{k}") for k, rule in rules.items()]
    hosts = counts.groupBy("host").agg(F.count("*").alias("n_docs"), *fails)
    rate = {k: F.col(f"fail_{k}") / F.col("n_docs") for k in rules}
    prior = hosts.agg(*[f(rate[k]).alias(f"{n}_{k}") for k in rules for n, f in (("m", F.avg), ("v", F.var_pop))])
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    for k in rules:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        strength = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0)))
        shrunken = (F.col(f"fail_{k}") + m * strength) / (F.col("n_docs") + strength)
        out = out.withColumn(f"rate_{k}", F.coalesce(shrunken, m))
    failed = reduce(lambda x, y: x | y, (F.col(f"rate_{k}") > limit for k in rules))
    return out.withColumn("host_kept", ~failed).drop(*[f"{n}_{k}" for k in rules for n in "mv"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and the host's shrunken rates of every document."""
    counts = keep(document_counts(docs))
    rules = host_rules()
    hosts = host_verdicts(counts)
    judged = counts.withColumn("base_failed", rules["short"] | rules["repeats"])
    both = judged.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))
