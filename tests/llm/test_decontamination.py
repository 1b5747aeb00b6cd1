"""Windows of items in documents, against a plain search."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from lexiforge.llm import decontamination, storage
from lexiforge.llm.decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            wanted.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in wanted}:
            for i in range(len(w) - size + 1):
                if (got := wanted.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= {str(g) for g in got if g is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def made(seed):
    """Texts of few different words, so that shingles repeat, with pieces of items at beginnings, ends and upon each other."""
    draw = random.Random(seed)
    text = lambda n: draw.choice([" ", ", ", "\n", "-"]).join(draw.choice(["a", "B", "c", "é", "9x"]) for _ in range(n))
    items = [(i, text(draw.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 30]) if i > 7 else 14)) for i in range(40)]
    docs = []
    for i in range(200):
        _, item = draw.choice(items)
        piece = " ".join(item.split()[: draw.randint(1, 30)])
        docs.append((i, f"{text(draw.randint(0, 30))} {piece} {text(draw.randint(0, 8))} {draw.choice(items)[1]}"))
    return docs, items


@pytest.mark.parametrize("few", [0, 50_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_search(spark, monkeypatch, seed, few):
    monkeypatch.setattr(storage, "FEW_ROWS", few)
    docs, items = made(seed)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination(*frames)) == plain(docs, items)
    long = [(i, t) for i, t in items if len(words(t)) >= 6]
    longer = contamination(frames[0], spark.createDataFrame(long, "item_id long, text string"), window=6, shingle=3)
    assert rows(longer) == plain(docs, long, 6)


HARD = [(1, None), (2, ""), (3, " .,\n"), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten"), (None, "ONE.two/three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine"), (6, "x " * 50_000 + "two three four five six seven eight nine ten eleven"), (7, "short"), (8, "two words")]
ITEMS = [(10, "one two three four five six seven eight nine ten eleven"), (10, "one two three four five six seven eight nine ten eleven"), (9, "One Two three four five six seven eight nine ten"), (None, "two three four five six seven eight nine ten eleven"), (3, None), (4, ""), (5, "--"), (6, "SHORT"), (7, "two-words")]


def test_hard_rows(spark):
    docs = spark.createDataFrame(HARD, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'x' AS _row", "2 AS row", "3 AS window", "4 AS shingle", "5 AS _text", "'o' AS source")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS size")
    found = contamination(docs, items, keep_text=True, spans_col="spans", items_col="ids")
    assert rows(found) == plain(HARD, ITEMS)
    by = {r.doc_id: r for r in found.collect()}
    assert [tuple(s) for s in by[6].spans] == [(50_000, 50_010)] and by[6].ids == ["10"] and by[4].ids == ["10", "9"] and by[6].source == "o" and by[8].text == "two words"
    assert contamination(docs.limit(0), items).count() == 0
    none = contamination(docs, items.limit(0))
    assert none.count() == len(HARD) and none.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_wrong_bits_cost_rows_only(spark, monkeypatch):
    docs, items = made(3)
    table = decontamination.bit_table

    def full(windows):
        return table(windows) | 255

    monkeypatch.setattr(decontamination, "bit_table", full)
    assert rows(contamination(spark.createDataFrame(docs[:60], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs[:60], items)
