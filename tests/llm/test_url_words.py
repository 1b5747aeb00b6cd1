"""The URL filter's segmentation and verdicts against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import url_filter
from lexiforge.llm.registry import QUERIES

LETTERS = re.compile(r"[^\W\d_]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def host_and_path(url):
    _, sep, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest)[0] if sep else ""
    return low(host), re.split("[?#]", rest[len(host) :])[0] if sep else ""


def rule_of(host, path):
    fits = [(h + p, says) for says, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def plain_cut(label, score, total):
    """The best cut by trying every last word."""
    best = [(0.0, [])]
    for end in range(1, len(label) + 1):
        ways = []
        for begin in range(end):
            word = label[begin:end]
            own = [math.log(10) * (1 - len(word)) - math.log(total)] + ([score[word]] if word in score else [])
            ways += [(best[begin][0] + x, best[begin][1] + [word]) for x in own]
        best.append(max(ways, key=lambda w: w[0]))
    return best[-1]


def plain_verdicts(urls, examples=()):
    split = [host_and_path(u) for u in urls]
    every = [(*hp, rule_of(*hp)[1]) for hp in split] + [(*host_and_path(u), says) for u, says in examples]
    n = Counter({w: url_filter.LISTED_COUNT for w in url_filter.FREQUENT})
    for host, path, _ in every:
        n.update(LETTERS.findall(low(path)))
        n.update(w for label in host.split(".") if "-" in label for w in LETTERS.findall(label))
    total = sum(n.values())
    score = {w: math.log(c / total) for w, c in n.items()}
    words = lambda host, path: [f"host {w}" for label in LETTERS.findall(host) for w in plain_cut(label, score, total)[1]] + [f"path {w}" for w in LETTERS.findall(low(path))]
    pages, counts = Counter(), {"block": Counter(), "allow": Counter()}
    for host, path, says in every:
        if says:
            pages[says] += 1
            counts[says].update(words(host, path))
    v = len(set(counts["block"]) | set(counts["allow"]))
    out = []
    for host, path in split:
        rule, says = rule_of(host, path)
        odds = math.log((pages["block"] + 1) / (pages["allow"] + 1))
        for w in words(host, path):
            if w in counts["block"] or w in counts["allow"]:
                b, a = ((counts[k][w] + 1) / (sum(counts[k].values()) + v) for k in ("block", "allow"))
                odds += math.log(b) - math.log(a)
        out.append((host, path, rule, says or ("block" if odds > 0 else "allow"), odds))
    return out


def same(found, urls, examples=()):
    for r, (host, path, rule, verdict, odds) in zip(found, plain_verdicts(urls, examples), strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or rule is None and abs(odds) < 1e-9


def test_verdicts_of_the_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op10_url_filter"](spark, sf_dir).orderBy("page_id").collect()
    same(found, [urls[r.page_id] for r in found])
    assert {r.verdict for r in found if r.rule is None} == {"allow", "block"}


def hard_urls():
    draw = random.Random(4)
    words = "garden casino news pills club river free bets shop".split()
    urls = [None, "", "no scheme", "http://", "://x/y", "http://EXAMPLE.com", "http://" + "a" * 300 + ".net/" + "b" * 500, "http://ümlaut-straße.example.net/été", "http://1.2.3.4/5"]
    for _ in range(150):
        host = "".join(draw.choices(words, k=draw.randrange(1, 4)))
        urls.append(f"http://{draw.choice(['www.', ''])}{host}.example.{draw.choice(['com', 'org', 'net'])}/{draw.choice(['de', 'fr', 'en', 'es'])}/{draw.choice(words)}-{draw.choice(words)}/{draw.randrange(30)}?q")
    return urls + urls[:20]


@pytest.mark.parametrize("broadcast", [True, False])
def test_verdicts_against_a_plain_version(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_WORDS", 0)
    urls = hard_urls()
    df = spark.createDataFrame(list(enumerate(urls)), "i long, url string")
    same(url_filter.judge_urls(df).orderBy("i").collect(), urls)
    examples = [("http://casino.example.net/play", "block")] * 40 + [("http://gardenclub.example.net/roses", "allow")] * 40
    judged = spark.createDataFrame(examples, "url string, verdict string")
    found = url_filter.judge_urls(df, judged=judged).orderBy("i").collect()
    same(found, urls, examples)
    by_word = {w: {r.verdict for r in found if r.rule is None and w in r.host and r.path.startswith("/en/")} for w in ("casinocasino", "gardengarden")}
    assert "allow" not in by_word["casinocasino"] and "block" not in by_word["gardengarden"]


def test_pages_that_it_has_not_learnt_from(spark):
    """Learnt from half of the pages that rules decide, tried on the other half: most blocked pages are found, few others."""
    host, path = url_filter.host_and_path(F.col("url"))
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", host.alias("h"), path.alias("p"))
    decided = pages.withColumn("verdict", url_filter.by_rules(F.col("h"), F.col("p"))[1]).where("verdict IS NOT NULL").withColumn("half", F.crc32(F.concat("h", "p")) % 2)
    tried = decided.where("half = 1").select("url", F.col("verdict").alias("expected"))
    found = url_filter.judge_urls(tried, rules=(), judged=decided.where("half = 0").select("url", "verdict")).groupBy("expected", "verdict").count().collect()
    n = Counter({(r.expected, r.verdict): r["count"] for r in found})
    blocked = n["block", "block"]
    assert blocked / (blocked + n["block", "allow"]) >= 0.7 and blocked / (blocked + n["allow", "block"]) >= 0.85


def test_cuts_against_all_cuts():
    draw = random.Random(9)
    score = {w: -draw.random() * 9 - 1 for w in "a b ab ba aab abab bbb abba".split()}
    for _ in range(200):
        label = "".join(draw.choices("abc", k=draw.randrange(1, 14)))
        known = [(i, j, score[label[i:j]]) for i in range(len(label)) for j in range(i + 1, len(label) + 1) if label[i:j] in score]
        cut = url_filter.best_cut(label, known, math.log(500))
        assert "".join(cut) == label
        value = sum(max([math.log(10) * (1 - len(w)) - math.log(500)] + ([score[w]] if w in score else [])) for w in cut)
        assert abs(value - plain_cut(label, score, 500)[0]) < 1e-9


def test_columns_of_any_names_and_empty_tables(spark):
    df = spark.createDataFrame([("http://a.example.net/x", 1, 2, 3, 4)], "url string, _host int, _path int, _rule int, n int")
    assert url_filter.judge_urls(df).select("url", "_host", "_path", "_rule", "n").collect() == df.collect()
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, rules=()).collect()} == {"allow"}
