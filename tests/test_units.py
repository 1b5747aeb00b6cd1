"""Predicates, folds of text and of rows, pages, payloads and files, against vectors and plain versions."""

from __future__ import annotations

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiforge.functions import canonical, payloads
from lexiforge.functions import predicates as P
from lexiforge.functions import text as X
from lexiforge.operators.folds import ordered_fold
from lexiforge.operators.profile import Profile
from lexiforge.plans import leases
from lexiforge.sources import tables as S


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def answers(spark, values, expression, kind="string"):
    return [r.y for r in column(spark, values, kind).select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_search_and_sort_folds(spark):
    assert answers(spark, ["  ISTANBUL  ", "ＡＢＣ", "آمِنَة", "مسـؤول", "عبد  الله", None], X.search_fold) == ["istanbul", "abc", "امنه", "مسوول", "عبد الله", None]
    same = [("Café", "Café"), ("علی", "علي"), ("مالک", "مالك"), ("عَلِيّ", "علي"), ("شاطئ", "شاطي")]
    for a, b in same:
        x, y = answers(spark, [a, b], X.search_fold)
        assert x == y
    names = ["آمنة", "بدر", "أحمد", "إبراهيم"]
    keys = answers(spark, names, X.sort_fold)
    assert [n for _, n in sorted(zip(keys, names))] == ["إبراهيم", "أحمد", "آمنة", "بدر"]


def test_localized_counts(spark):
    assert answers(spark, ["١٬٢٣٤ بيت", "۱۲۳", "42 قصيدة", "لا توجد ٠ قصائد", "12 من 20", "none", None, "99999999999"], X.localized_count) == [1234, 123, 42, 0, None, None, None, None]


def test_identities(spark):
    cases = {"a": True, "": False, " a": False, ".": False, "..": False, "a/b": False, "a\x00b": False, "a‮b": False, "x" * 500: True, "x" * 501: False, "tab\tis fine": True}
    assert answers(spark, [*cases], P.safe_identity) == [*cases.values()]
    assert answers(spark, ["", "  ", "a"], P.blank_to_null) == [None, None, "a"]
    assert answers(spark, [None, "a"], lambda c: P.differs(c, F.lit("a"))) == [True, False]


def test_keyset_pages_visit_every_row_once(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(4), draw.choice("abc"), i) for i in range(60)]
    df, keys = spark.createDataFrame(rows, "p int, k string, i int"), [("p", False), ("k", True), ("i", True)]
    seen, cursor = [], None
    while page := (df if cursor is None else df.where(P.after(keys, cursor))).orderBy(*P.in_order(keys)).limit(7).collect():
        seen += [tuple(r) for r in page]
        cursor = [page[-1].p, page[-1].k, page[-1].i]
    assert seen == sorted(rows, key=lambda r: (-r[0], r[1], r[2]))


def test_canonical_json(spark):
    given = ['{"b":1.0,"a":{"Z":-0.0,"y":[1,null]},"B":"é\\n"}', "3", "no", None, "[1e400]", '{"a":1e21}']
    assert answers(spark, given, lambda c: canonical.canonical_json(c, "source"))[:4] == ['{"B":"é\\n","a":{"Z":0,"y":[1,null]},"b":1}', "3", None, None]
    assert answers(spark, given, lambda c: canonical.canonical_json(c, "bound"))[0] == '{"a":{"y":[1,null],"Z":0},"b":1,"B":"é\\n"}'
    assert answers(spark, given, lambda c: canonical.canonical_json(c, "work"))[4] is None
    assert answers(spark, ["[" * 100_000], lambda c: canonical.canonical_json(c, "work")) == [None]


def test_references_at_any_depth(spark):
    own = "123e4567-e89b-12d3-a456-426614174000"
    deep = json.dumps(own)
    for k in range(40):
        deep = f'[{deep}]' if k % 2 else f'{{"k":{deep}}}'
    bad = [own.replace("12d3", "02d3"), own.replace("a456", "c456"), own[:-1], own.replace("-", "_")]
    df = spark.createDataFrame([(1, deep), (2, json.dumps([own.upper(), own, {own: 1}])), (3, json.dumps(bad)), (4, "broken"), (5, None)], "id long, p string")
    assert sorted(tuple(r) for r in canonical.references(df, "id", "p").collect()) == [(1, own), (2, own)]


def test_titles_match_as_wholes(spark):
    good = ["Not translated to English", "My poem translation: more", "The attempt", "I'm sorry, love", "x" * 200]
    bad = ["Translated to English", "MY POEM TRANSLATION:", "An attempt at translation", "I'm sorry, no translation", "x" * 201, "a\rb", "", None, "(here is) a [translation]"]
    assert answers(spark, good + bad, payloads.usable_title) == [True] * len(good) + [False] * len(bad)


def test_ndjson_is_strict(spark, tmp_path):
    schema = "a long, b string"
    (tmp_path / "good").mkdir()
    (tmp_path / "good/x.json").write_text('{"a":1,"b":"x"}\n\n   \n{"a":2,"b":null}\n')
    struct = spark.createDataFrame([], schema).schema
    assert sorted(tuple(r) for r in S.read_ndjson(spark, str(tmp_path / "good"), struct).collect()) == [(1, "x"), (2, None)]
    for name, text in (("cut", '{"a":1\n'), ("kind", '{"a":"one"}\n'), ("long", json.dumps({"b": "x" * 300}) + "\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
        with pytest.raises((PySparkException, Py4JJavaError)):
            S.read_ndjson(spark, str(tmp_path / name), struct, longest_line=200).collect()


def test_exports_are_replayed_or_refused(spark, tmp_path):
    df, folder = spark.createDataFrame([(2, "b"), (1, None)], "a long, b string"), str(tmp_path / "out")
    assert [tuple(r)[0::2] for r in S.export_snapshot(df, folder, "a").collect()] == [(2, False)]
    assert [tuple(r)[0::2] for r in S.export_snapshot(df.orderBy("a"), folder, "a").collect()] == [(2, True)]
    with pytest.raises(ValueError):
        S.export_snapshot(df.where("a = 1"), folder, "a")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out/rows").glob("part-*"))) == '{"a":1,"b":null}\n{"a":2,"b":"b"}\n'
    assert S.content_digest(df).first() == S.content_digest(df.repartition(5)).first() != S.content_digest(df.union(df)).first()


def test_content_digest_by_more_buckets(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "cast(id % 7 as string) as s")
    monkeypatch.setattr(S, "BUCKET_ROWS", 2)
    assert S.content_digest(df).first() == S.content_digest(df.orderBy("s")).first()
    assert S.content_digest(df).first().rows == 3000


def test_artifacts(spark, tmp_path):
    folder, texts = str(tmp_path / "a"), spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "text string")
    assert S.put_artifacts(texts, folder).count() == 2 and S.put_artifacts(texts, folder).count() == 2
    assert S.stored_artifacts(spark, folder).count() == 2 and S.verify_artifacts(spark, folder).count() == 0
    spark.createDataFrame([("ab" * 32, "z", "ab")], "sha256 string, value string, fan string").write.mode("append").partitionBy("fan").parquet(folder)
    assert [r.value for r in S.verify_artifacts(spark, folder).collect()] == ["z"]


def test_extracts(spark, tmp_path):
    path = str(tmp_path / "e")
    S.write_extract(spark.range(1000).selectExpr("id as k", "id * 2 as v"), path, "k", files=4)
    assert [r.v for r in S.lookup(spark, path, "k", 77).collect()] == [154]
    assert sorted(r.v for r in S.lookup_all(spark, path, spark.createDataFrame([(3,), (5,), (-1,)], "k long")).collect()) == [6, 10]


def test_ordered_folds_of_hot_and_small_keys(spark):
    rows = [(i % 50 if i % 3 else 0, i, i % 11) for i in range(4000)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(6)
    step = lambda state, row: (state + row["v"], {"o": row["o"], "total": state + row["v"]} if row["v"] else None)
    found = {(r.k, r.o): r.total for r in ordered_fold(df, "k", ["o"], lambda: 0, step, "o long, total long").collect()}
    totals, expected = {}, {}
    for k, o, v in rows[:-1]:
        totals[k] = totals.get(k, 0) + v
        if v:
            expected[k, o] = totals[k]
    assert found == expected
    assert ordered_fold(df.limit(0), "k", ["o"], lambda: 0, step, "o long, total long").count() == 0


def test_leases_are_fenced():
    day, state, said = leases.DAY, ("pending", 0, 0), []
    for k, (kind, t) in enumerate([("view", 0), ("view", 1), ("click", day - 1), ("purchase", 2 * day - 2), ("view", 2 * day)]):
        state, made = leases.lease_step(state, {"event_type": kind, "t": t, "k": 1, "event_id": k})
        said.append((made["outcome"], made["epoch"]))
    assert said == [("claimed", 1), ("busy", 1), ("renewed", 1), ("succeeded", 1), ("done", 1)]
    late = leases.lease_step(("running", 3, 10), {"event_type": "purchase", "t": 10, "k": 1, "event_id": 1})
    stale = leases.lease_step(("running", 3, 10), {"event_type": "error", "t": 5, "k": 4, "event_id": 1})
    assert late == (("pending", 3, 10), {"event_id": 1, "outcome": "lost_lease", "epoch": 3}) and stale[1]["outcome"] == "lost_lease" and stale[0][0] == "running"


def test_profiles(spark):
    own = Profile("https://a.example", "/poem/{slug}.html")
    paths = {"/poem/x.html": "x", "/poem/.html": None, "/poem/x/y.html": None, "/poem/x.htm": None, "/Poem/x.html": None, "/poem/x?.html": None, "/poem/a.b.html": "a.b", None: None}
    assert answers(spark, [*paths], own.parse) == [*paths.values()]
    assert answers(spark, ["x", None], own.render) == ["https://a.example/poem/x.html", None]
    for bad in (("http://a", "/{x}"), ("https://a", "{x}"), ("https://a", "/x"), ("https://a", "/{x}/{y}"), ("https://a", "/{x}?q"), ("https://a/b", "/{x}"), ("https://a", "/{x}}")):
        with pytest.raises(ValueError):
            Profile(*bad)
