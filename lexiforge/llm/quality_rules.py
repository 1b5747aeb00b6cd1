"""Quality rules per document and per host (operator 7), with DataFrame functions only.

Each text's words, symbols, repeated lines and repeated five-word windows are
counted by array functions; a document fails if it has too few words or repeats
too many (the base rules). These and the other ``RULES`` are aggregated by host
(here: the source): for each rule, a host's rate of failures is shrunk to that of the
corpus by a beta prior that is fitted to all hosts by the method of moments. Of the
spread between hosts the binomial part, which chance alone makes, is taken out first,
so small hosts are shrunk as far as their few documents tell. A host of which some
rule's shrunk rate reaches ``MAX_HOST_RATE`` loses all its documents.

Defined results: null and empty texts have no words and fail. Null hosts form
one host of their own. With fewer than two hosts, or hosts that spread no more than
chance makes them, the prior has ``STRONG_PRIOR`` documents. An empty table gives an
empty result. Repeated rows count as often as they stand. Hosts' counts are combined
before the shuffle; the join with the verdicts sees a hot host whole, and
adaptive execution splits it (or broadcasts the verdicts if they are small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.storage import settle, table, unused

#: Words are runs of other characters than space and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is dropped if so large a part of its documents fails one of the rules, after shrinking.
MAX_HOST_RATE = 0.5
#: Documents that the prior counts for at least and at most.
WEAK_PRIOR, STRONG_PRIOR = 1.0, 1000.0
#: The rules by name; the first two are the base rules. Valid in Spark and DuckDB.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
BASE = ("few_words", "repeats")


def repeated_words(words: Column, n: Column) -> Column:
    """How many words lie in windows of five that stand twice or more in ``words``.

    Most texts repeat no window: comparing the number of distinct windows tells.
    Else the windows are sorted with their places, those next to an equal one
    are repeated, and each adds the words that the one before doesn't cover.
    """
    at = lambda i, k: F.element_at(words, i + k)
    starts = F.sequence(F.lit(0), n - WINDOW)
    keys = F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(1, WINDOW + 1)]))
    # the exact windows, with U+001F between words, decide where hashes agree
    placed = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws("\x1f", *[at(i, k) for k in range(1, WINDOW + 1)]).alias("w"), i.alias("i"))))

    def repeated(sorted_: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(sorted_, j)["w"] == x["w"], F.lit(False))
        return F.array_sort(F.transform(F.filter(sorted_, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1)), lambda x: x["i"]))

    # as the one element of an array the sorted windows are computed once, not for each place
    twice = F.transform(F.array(placed), repeated)[0]
    covered = F.aggregate(
        twice,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).cast("long").alias("sum"), i.alias("last")),
        lambda s: s["sum"],
    )
    return F.when(n < WINDOW, F.lit(0)).when(F.size(F.array_distinct(keys)) == n - WINDOW + 1, F.lit(0)).otherwise(covered).cast("long")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = unused(docs, "_words")
    split = docs.withColumn(own, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    words, n = F.col(own), F.size(own)
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    counted = split.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(words, n),
        }
    )
    return counted.drop(own)


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))


def host_verdicts(judged: DataFrame, host: Column) -> DataFrame:
    """One row per host: the host, the largest shrunk rate of failures and ``host_kept``."""
    hosts = judged.groupBy(host.alias("host")).agg(F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()])
    n, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    priors = []
    for name in RULES:
        mean = F.sum(name) / n
        spread = F.sum(F.col(name) * F.col(name) / F.col("n")) - F.sum(name) * F.sum(name) / n
        chance = (F.count("*") - 1) * mean * (1 - mean)
        between = (spread - chance) / F.nullif(n - squares / n - (F.count("*") - 1), F.lit(0.0))
        # of a beta distribution with this mean and spread
        weight = F.when(between > 1e-12, F.least(F.lit(STRONG_PRIOR), F.greatest(F.lit(WEAK_PRIOR), mean * (1 - mean) / F.nullif(between, F.lit(0.0)) - 1))).otherwise(F.lit(STRONG_PRIOR))
        priors += [mean.alias(f"{name}_mean"), weight.alias(f"{name}_weight")]
    joined = hosts.crossJoin(F.broadcast(hosts.agg(*priors)))  # one row
    rates = [(F.col(name) + F.col(f"{name}_mean") * F.col(f"{name}_weight")) / (F.col("n") + F.col(f"{name}_weight")) for name in RULES]
    return joined.select("host", F.greatest(*rates).alias("host_rate")).withColumn("host_kept", F.col("host_rate") < MAX_HOST_RATE)


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``host_rate`` and ``kept``; these replace columns of the same names."""
    judged = text_counts(docs, text_col).withColumn("base_failed", base_failed())
    host, rate, kept = (unused(judged, f"_{c}") for c in ("host", "rate", "kept"))
    hosts = host_verdicts(judged, F.col(host_col)).toDF(host, rate, kept)
    joined = judged.join(hosts, F.col(host_col).eqNullSafe(F.col(host)), "left")
    return joined.withColumns({"host_rate": F.col(rate), "kept": ~F.col("base_failed") & F.col(kept)}).drop(host, rate, kept)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # the counts are used twice (by host, by document): they are computed once
    judged = settle(text_counts(docs).drop("text").withColumn("base_failed", base_failed()))
    hosts = host_verdicts(judged, F.col("source"))
    joined = judged.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.round("host_rate", 6).alias("host_rate"))


OP7_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS t(k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
         CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
j AS (SELECT *, {" OR ".join(f"({RULES[name]})" for name in BASE)} AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in RULES.items())} FROM j GROUP BY source),
l AS (SELECT source, n, rule, failed FROM h UNPIVOT (failed FOR rule IN ({", ".join(RULES)}))),
m AS (
  SELECT rule, sum(failed) / sum(n) AS mean, sum(failed * failed / n) - sum(failed) * sum(failed) / sum(n) AS spread,
         (count(*) - 1) * (sum(failed) / sum(n)) * (1 - sum(failed) / sum(n)) AS chance,
         sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS freedom FROM l GROUP BY rule),
p AS (
  SELECT rule, mean, CASE WHEN (spread - chance) / nullif(freedom, 0) > 1e-12
    THEN least({STRONG_PRIOR}, greatest({WEAK_PRIOR}, mean * (1 - mean) / nullif((spread - chance) / freedom, 0) - 1)) ELSE {STRONG_PRIOR} END AS weight FROM m),
v AS (SELECT source, max((failed + mean * weight) / (n + weight)) AS host_rate FROM l JOIN p ON l.rule = p.rule GROUP BY source)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate < {MAX_HOST_RATE} AS kept, round(host_rate, 6) AS host_rate
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
