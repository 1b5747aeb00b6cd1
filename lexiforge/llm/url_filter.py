"""URL filters: rules, then host word segmentation and naive Bayes (operator 10).

Rules of host and path decide first; the longest that fits wins. They also give
the examples: pages that a rule blocks or allows are the two classes of a
multinomial naive Bayes model over the words of host and path, which judges the
pages without a rule. A word of a host and the same word of a path are two tokens: what
a country's name says in a host it need not say in a path. Further examples may be given as
a table of judged URLs.

Host labels are cut into words first. All substrings of a label that are as long as
some word of the lexicon are joined with it, and a Viterbi pass finds the cut of the
largest unigram probability, where an unknown word costs a factor of ten for each
letter. The lexicon counts, over all pages, the words of paths and of hyphenated
labels; a list of frequent words of host names stands behind it. Neither the list
nor the lexicon says anything of a verdict.

All of it is joins and sums: hosts and paths are made distinct before they are
cut, joined or scored, and counts are combined before each shuffle. The lexicon is
broadcast up to ``BROADCAST_WORDS`` words of ``BROADCAST_LETTERS`` letters in all;
beyond, it is joined by shuffle, and its short words, which many labels have, are
spread over ``SALTS`` keys.

Defined results: a null URL or one without ``://`` has an empty host and path, no
words, and the class that is likelier without any. Without examples of a class, the
other one wins. Equal odds allow. Labels and words of any length are handled.
Repeated rows are judged alike and count as often as they stand. An empty table gives
an empty result. Other columns pass, whatever their names; columns named like the
results are replaced.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.storage import lower_ascii, settle, table, unused

#: (verdict, host, path): fits the host and all its subdomains, and paths that begin so.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Frequent words of host names, so that they are known before any path has them.
FREQUENT = "adult all art best bet bets betting big blog book books buy cars casino cheap city club code cook data day deal deals escort farm fast film find food free fun gambling game games get go good health help home hot house info jackpot job jobs kids land life link live lottery mail malware map media music my net new news now online page phishing photo pill pills play poker porn post red school sex shop site sky slots spam sports star store tech the time top torrent tour travel viagra warez web wiki win work world you".split()
#: What a listed word counts for beside the words found.
LISTED_COUNT = 20
#: Up to so many words and letters the lexicon is broadcast.
BROADCAST_WORDS, BROADCAST_LETTERS = 200_000, 4_000_000
#: Beyond, words up to so many letters are joined under several keys.
SHORT, SALTS = 4, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (null if none does) and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def letters(text: Column) -> Column:
    """The words of letters, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(r"\p{L}+"), F.lit(0))


def lexicon(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, score, total): log probabilities of the words of all paths, of hyphenated labels, and of the list; the log of all words' count."""
    of_paths = paths.select(F.explode(letters(F.col("path"))).alias("word"), "n")
    hyphened = F.filter(F.split("host", r"\."), lambda label: label.contains("-"))
    of_hosts = hosts.select(F.explode(F.flatten(F.transform(hyphened, letters))).alias("word"), "n")
    listed = hosts.sparkSession.createDataFrame([(w, LISTED_COUNT) for w in FREQUENT], "word string, n long")
    counts = of_paths.union(of_hosts).union(listed).groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", F.log(F.col("n") / F.col("total")).alias("score"), F.log("total").alias("total"))


def best_cut(label: str, known: list[tuple[int, int, float]], log_total: float) -> list[str]:
    """Viterbi over the label; known: (begin, end, score) of its words; an unknown one of k letters has probability 10 / (total * 10^k).

    Of equal sums the one whose last word is the longest stays.
    """
    letter, n = math.log(10), len(label)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for begin, end, score in known:
        ends[end].append((begin, score))
    best, came = [0.0] * (n + 1), [0] * (n + 1)
    # of all places the one from where an unknown word does best: what it costs falls by a letter at each step
    start, lead = 0, 0.0
    for end in range(1, n + 1):
        options = [(lead + letter * (1 - end) - log_total, -start)]
        options += [(best[begin] + score, -begin) for begin, score in ends[end]]
        best[end], back = max(options)
        came[end] = -back
        if best[end] + letter * end > lead:
            start, lead = end, best[end] + letter * end
    words = []
    while n:
        words.append(label[came[n] : n])
        n = came[n]
    return words[::-1]


def cut_words(label: Column, parts: Column, total: Column) -> Column:
    @F.arrow_udf("array<string>")
    def cut(labels: pa.Array, parts: pa.Array, totals: pa.Array) -> pa.Array:
        rows = zip(labels.to_pylist(), parts.to_pylist(), totals.to_pylist())
        return pa.array([best_cut(label, [(p["begin"], p["end"], p["score"]) for p in known or []], total) for label, known, total in rows], pa.list_(pa.string()))

    return cut(label, parts, total)


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words) of distinct labels; their substrings are joined with the lexicon ``words``, which is settled."""
    found = words.agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("letters"), F.max("total").alias("total"), F.array_sort(F.collect_set(F.length("word"))).alias("lengths")).first()
    begins = labels.select("label", F.explode(F.sequence(F.lit(0), F.length("label") - 1)).alias("begin"))
    # only lengths that some word has; there are as many as the longest word has letters at most
    spans = begins.select("label", "begin", F.explode(F.filter(F.lit(found["lengths"] or [0]), lambda k: k <= F.length("label") - F.col("begin"))).alias("k"))
    spans = spans.select("label", "begin", (F.col("begin") + F.col("k")).alias("end"), F.expr("substring(label, begin + 1, k)").alias("word"))
    if found["n"] <= BROADCAST_WORDS and (found["letters"] or 0) <= BROADCAST_LETTERS:
        parts = spans.join(F.broadcast(words.select("word", "score")), "word")
    else:
        short = F.length("word") <= SHORT
        salted = spans.withColumn("salt", F.when(short, F.pmod(F.xxhash64("label"), F.lit(SALTS))).otherwise(F.lit(0)))
        copies = F.when(short, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        parts = salted.join(words.select("word", "score", F.explode(copies).alias("salt")), ["word", "salt"])
    known = parts.groupBy("label").agg(F.collect_list(F.struct("begin", "end", "score")).alias("parts"))
    return labels.join(known, "label", "left").select("label", cut_words(F.col("label"), F.col("parts"), F.lit(found["total"])).alias("words"))


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words)"""
    labels = hosts.select("host", F.explode(letters(F.col("host"))).alias("label"))
    cut = segmented(labels.select("label").distinct(), words)
    own = labels.join(cut, "label").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
    return hosts.join(own, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def host_tokens(words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit("host "), w))


def path_tokens(path: Column) -> Column:
    return F.transform(letters(path), lambda w: F.concat(F.lit("path "), w))


def examples(pairs: DataFrame, column: str) -> DataFrame:
    """(column, block, allow): the pages of each class by host or path."""
    count = lambda says: F.coalesce(F.sum(F.when(F.col("known") == says, F.col("n"))), F.lit(0)).alias(says)
    return pairs.where("known is not null").groupBy(column).agg(count("block"), count("allow"))


def bayes(hosts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, float]:
    """(word, odds), the log odds of ``block`` with add-one smoothing, and those of a page before any word; from pairs whose verdict is ``known``."""
    of_hosts = examples(pairs, "host").join(hosts, "host").select(F.explode(host_tokens(F.col("words"))).alias("word"), "block", "allow")
    of_paths = examples(pairs, "path").select(F.explode(path_tokens(F.col("path"))).alias("word"), "block", "allow")
    counts = settle(of_hosts.union(of_paths).groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    total = counts.agg(F.sum("block").alias("all_block"), F.sum("allow").alias("all_allow"), F.count("*").alias("v"))
    odds = F.log((F.col("block") + 1) / (F.col("all_block") + F.col("v"))) - F.log((F.col("allow") + 1) / (F.col("all_allow") + F.col("v")))
    seen = pairs.agg(*[F.coalesce(F.sum(F.when(F.col("known") == says, F.col("n"))), F.lit(0)).alias(says) for says in ("block", "allow")]).first()
    return counts.crossJoin(F.broadcast(total)).select("word", odds.alias("odds")), math.log((seen["block"] + 1) / (seen["allow"] + 1))


def with_host_odds(pairs: DataFrame, host_odds: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pairs`` with the odds of their hosts; the pairs of a host that has a large part of them are spread over ``SALTS`` keys."""
    size = hosts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host")), F.lit(0)).alias("letters")).first()
    if size["n"] <= BROADCAST_WORDS and size["letters"] <= BROADCAST_LETTERS:
        return pairs.join(F.broadcast(host_odds), "host", "left")
    copies = host_odds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS))).join(copies, ["host", "salt"], "left").drop("salt")


def judge_urls(pages: DataFrame, url_col: str = "url", host_col: str = "host", path_col: str = "path", rule_col: str = "rule", verdict_col: str = "verdict", rules=RULES, judged: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, the rule that fits and the verdict; judged: further examples (url, verdict)."""
    host, path = host_and_path(F.col(url_col))
    pairs = pages.groupBy(host.alias("host"), path.alias("path")).agg(F.count("*").alias("n"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    pairs = settle(pairs.select("host", "path", "n", rule.alias("rule"), verdict.alias("known")))
    learnt = pairs
    if judged is not None:
        h, p = host_and_path(F.col("url"))
        learnt = settle(pairs.drop("rule").union(judged.select(h, p, F.lit(1).cast("long"), "verdict")))
    hosts = learnt.groupBy("host").agg(F.sum("n").alias("n"))
    paths = learnt.groupBy("path").agg(F.sum("n").alias("n"))
    words = settle(lexicon(hosts, paths))
    hosts = settle(host_words(hosts, words))
    odds, prior = bayes(hosts, learnt)
    odds = settle(odds)
    # only what no rule decides is scored
    open_pairs = pairs.where("known is null")
    host_odds = hosts.join(open_pairs.select("host").distinct(), "host").select("host", F.explode(host_tokens(F.col("words"))).alias("word")).join(odds, "word").groupBy("host").agg(F.sum("odds").alias("host_odds"))
    path_odds = open_pairs.select("path").distinct().select("path", F.explode(path_tokens(F.col("path"))).alias("word")).join(odds, "word").groupBy("path").agg(F.sum("odds").alias("path_odds"))
    score = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    own = [unused(pages, c) for c in ("_host", "_path", "_rule", "_verdict", "_own_host", "_own_path")]
    found = with_host_odds(pairs, host_odds, hosts).join(path_odds, "path", "left")
    found = found.select("host", "path", "rule", F.coalesce("known", F.when(score > 0, "block").otherwise("allow"))).toDF(*own[:4])
    joined = pages.withColumns({own[4]: host, own[5]: path}).join(found, (F.col(own[4]) == F.col(own[0])) & (F.col(own[5]) == F.col(own[1])))
    return joined.withColumns(dict(zip((host_col, path_col, rule_col, verdict_col), map(F.col, own)))).drop(*own)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
