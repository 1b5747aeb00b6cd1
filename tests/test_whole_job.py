"""What the tables and their SQL don't show: hot groups, oversize rows, repeats and gaps."""

from __future__ import annotations

import hashlib
from itertools import groupby

import duckdb
from conftest import against_sql
from pyspark.sql import functions as F

from lexiforge.operators.html import segments
from lexiforge.operators.paging import budget_prefix
from lexiforge.plans import ORACLES, QUERIES, reconcile


def test_multiset_digest_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "RANGE_ROWS", 50)
    monkeypatch.setattr(reconcile, "BLOCK_ROWS", 7)
    rows = [("hot", f"text {i % 400}") for i in range(1000)] + [("hot", "copy")] * 100 + [("b", "x"), ("b", None), ("c", None), (None, "y")]
    made = reconcile.multiset_digests(spark.createDataFrame(rows, "source string, text string"))
    assert "collect_list" not in made._jdf.queryExecution().toString()
    expected = {}
    for source in {s for s, _ in rows}:
        own = sorted(hashlib.sha256(t.encode()).hexdigest() for s, t in rows if s == source and t is not None)
        expected[source] = (hashlib.sha256("".join(own).encode()).hexdigest() if own else None, sum(s == source for s, _ in rows))
    assert {r.source: (r.digest, r.n) for r in made.collect()} == expected


def test_budget_prefix_skips_what_alone_exceeds_the_budget(spark, tmp_path):
    sizes = [250_000, 90_000, 200_001, 60_000, 70_000, 10]
    rows = [(i, "", "en", "a", n) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["budget_prefix"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.running) for r in found) == [(1, 90_000), (3, 150_000)]


def test_budget_prefix_limits_the_items(spark):
    df = spark.createDataFrame([(i, 300 if i == 1 else 10) for i in range(9)], "id long, n long")
    assert sorted(tuple(r) for r in budget_prefix(df, "id", "n", 100, items=3).select("id", "running").collect()) == [(0, 10), (2, 20), (3, 30)]


def test_two_pass_certificate_sees_repeats_and_gaps(spark, tmp_path):
    turns = {1: [0, 1, 2], 2: [0, 0, 2], 3: [0, 2], 4: [1, 2], 5: [2, 0, 1], 6: [0, 1, 1, 3]}
    rows = [(c, t, "user" if i % 2 else "assistant", f"{9 - i} says") for c, own in turns.items() for i, t in enumerate(own)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in QUERIES["two_pass_certificate"](spark, str(tmp_path)).collect()}
    assert {c: r.certified for c, r in found.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    said = "\n".join(f"{r}:{t}" for _, _, r, t in sorted(x for x in rows if x[0] == 5))
    assert found[5].digest == hashlib.sha256(said.encode()).hexdigest()


def test_segments_against_brute_force(spark):
    texts = ["", "word", "  two  words ", "(a) b_c, d-e\n\tf9!", "\u0642\u0627\u0644 \u0627\u0644\u0634\u0627\u0639\u0631\u060c x", "...", "\u00fcml\u00e4ut 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in df.select("text", segments(F.col("text")).alias("parts")).collect():
        runs = ["".join(own) for _, own in groupby(r.text, key=str.isalnum)]
        assert r.parts == runs and "".join(r.parts) == r.text


def test_lossless_segments_of_texts_that_begin_with_blanks_or_are_none(spark, tmp_path):
    texts = [None, "", " ", "    ", "     ", "    a", "     a", "      a b", "     \n", "\n     a", "\t", "a\x00b", "\u00a0" * 6, "a     ", "one two three four five six", " " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = QUERIES["lossless_segments"](spark, str(tmp_path))
    against_sql(found, con, ORACLES["lossless_segments"])
    assert {r.doc_id for r in found.collect() if r.rebuilt} == {5, 9, 10, 11, 12, 13, 14}
