"""Resampling towards a target, against a plain version with copies, ties and longer features."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lexiforge.llm import storage
from lexiforge.llm.importance_resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, longest, n_buckets, percent, least, seed=2024):
    def parts(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    cut = [(i, *parts(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in cut for b in f), Counter(b for text in target for b in parts(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + n_buckets) / ((s[b] + 1) * (total_t + n_buckets)))) for b in s}
    rows = []
    for i, n, f in cut:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0], -r[1]))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least], key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize(("longest", "n_buckets", "percent", "few"), [(1, 10_000, 10, 50_000), (3, 97, 35, 50_000), (1, 50, 100, 0)])
def test_against_a_plain_version(spark, monkeypatch, longest, n_buckets, percent, few):
    monkeypatch.setattr(storage, "FEW_ROWS", few)
    monkeypatch.setattr(storage, "HOT_ROWS", 20)
    draw = random.Random(longest)
    text = lambda: " ".join(draw.choice(["alpha", "Beta", "x9", "naïve", "delta-e"]) for _ in range(draw.randint(0, 40)))
    docs = [(i, text()) for i in range(300)] + [(i + 300, "the same text " * 9) for i in range(150)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, text()), (7, None), (8, ""), (9, "..."), (10, "lone " * 30_000)]
    target = [text() for _ in range(20)] + [None, ""]
    found = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), longest, n_buckets, percent)
    assert rows(found) == plain(docs, target, longest, n_buckets, percent, 20)
    assert found.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS _digest", "3 AS copies", "4 AS buckets", "5 AS gains", "6 AS digest", "7 AS _at", "8 AS n_words")
    none = docs.limit(0)
    target = docs.select("text")
    assert resample(none, target).count() == 0
    lone = resample(docs, target.limit(0), percent=100).first()
    assert (lone.n_features, lone["rank"], lone._digest, lone.copies, lone.n_words) == (30, 1, 2, 3, 8)
