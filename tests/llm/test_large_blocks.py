"""Blocks of many small groups, hot shingles, sets whose keys agree, and joins on hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import components as C
from lexiforge.llm import jaccard_join, storage
from lexiforge.llm.jaccard_join import near_duplicates
from test_brute_force import brute_components


def chained_groups(groups, copies, name="g"):
    """Near copies in small groups; neighbours are chained by a rare passage that makes no link."""
    rows = []
    for g in range(groups):
        base = [f"{name}{g}w{k}" for k in range(44)]
        for c in range(copies):
            own = [f"{name}x{g}c{c}", *base]
            tail = [f"{name}chain{g + (c == 0)}of{k}" for k in range(5)] if c < 2 else []  # the first copy leads to the next group, the second comes from the last
            rows.append((len(rows), " ".join(own + tail)))
    return rows


def test_a_block_of_many_small_groups(spark, monkeypatch):
    sizes = []
    whole = jaccard_join.large_block_links
    monkeypatch.setattr(jaccard_join, "large_block_links", lambda rows: sizes.append(rows.count()) or whole(rows))
    rows = chained_groups(1000, 5)
    found = {r.id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sizes == [5000]
    assert found == {i: i - i % 5 for i, _ in rows}


def test_tiles_of_a_shingle_that_many_groups_have(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rows = chained_groups(40, 4) + [(1000 + i, t + " one passage that all of these have") for i, t in chained_groups(30, 4, 'h')]
    found = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_components(rows)


def test_common_shingles_change_nothing(spark, monkeypatch):
    line = "this work may be copied under the terms of its licence by anyone"
    rows = [(i, f"{line} {t}") for i, t in chained_groups(30, 4)] + [(500 + i, f"{line} {i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(jaccard_join.common_shingles(docs, "text", len(rows))) >= 9
    expected = brute_components(rows)
    assert {tuple(r) for r in near_duplicates(docs).collect()} == expected
    monkeypatch.setattr(jaccard_join, "HOT_TEXTS", 10**9)
    assert not len(jaccard_join.common_shingles(docs, "text", len(rows)))
    assert {tuple(r) for r in near_duplicates(docs).collect()} == expected


def test_sets_whose_keys_agree_are_told_apart(spark):
    rows = [(1, "a b c d e f"), (2, "u v w x y z"), (3, "A b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    agreed = jaccard_join.measured(docs, "doc_id", "text").select("key").distinct().count()
    assert agreed == 2
    sets = [s for block in jaccard_join.shingle_sets(jaccard_join.pa.array([t for _, t in rows[:2]])) for s in block]
    keys = [jaccard_join.set_key(s) for s in sets]
    assert jaccard_join.told_apart(sets[0], frozenset(keys[:1])) == jaccard_join.set_key(sets[0], 202) != keys[0]
    assert jaccard_join.told_apart(sets[1], frozenset(keys[:1])) == keys[1]


@pytest.mark.parametrize("few", [0, 1000])
def test_joins_on_hot_keys(spark, monkeypatch, few):
    monkeypatch.setattr(storage, "HOT_ROWS", 5)
    monkeypatch.setattr(storage, "FEW_ROWS", few)
    left = spark.createDataFrame([(i, i % 4 if i < 20 else 9) for i in range(60)] + [(99, None)], "i int, k int")
    right = left.where("k < 9").groupBy("k").agg(F.count("*").alias("n")).union(spark.createDataFrame([(9, 40)], "k int, n long")).withColumn("v", F.col("k") * 10)
    for how in ("inner", "left"):
        found = storage.join_hot(left, right, "k", "n", 60, how).select("i", "k", "v").collect()
        assert sorted(found, key=lambda r: r.i) == sorted(left.join(right, "k", how).select("i", "k", "v").collect(), key=lambda r: r.i)


@pytest.mark.parametrize("left", [0, 50, 200_000])
def test_components_with_hubs(spark, monkeypatch, left):
    monkeypatch.setattr(storage, "HOT_ROWS", 3)
    monkeypatch.setattr(storage, "FEW_ROWS", 0)
    monkeypatch.setattr(C, "EDGES_A_TASK", left)
    draw = random.Random(1)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(70)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)]
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = {r.v: r.label for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    together = lambda own: sorted(sorted(v for v in own if own[v] == x) for x in set(own.values()))
    assert together(found) == together(label)
