"""Budgets, targets and topics of the mixture, against a plain version."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from lexiforge.llm import mixing
from lexiforge.llm.mixing import DIMENSIONS, calibrated, measured, mixture_report, sample_mixture


def rows():
    draw = random.Random(8)
    out = []
    for i in range(4000):
        source = draw.choices(["web", "wiki", "code"], [6, 3, 1])[0]
        lang = draw.choices(["en", "de", None], [5, 3, 1])[0]
        kind = draw.choices(["science", "sport"], [1, 2 if source == "web" else 1])[0]
        out.append((i, " ".join(["w"] * draw.randrange(1, 60)), lang, source, kind, draw.random()))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, kind string, extra double"
TARGETS = {"source": {"web": 1.0, "wiki": 1.0, "code": 0.5}, "lang": {"en": 3.0, "de": 3.0, "(none)": 1.0}, "topic": {"science": 2.0, "sport": 3.0}}


def tables(spark, targets):
    return {d: spark.createDataFrame([*own.items()], f"{d} string, target double") for d, own in targets.items()}


def plain(docs, targets, budget, rounds):
    tokens = defaultdict(float)
    for _, text, lang, source, kind, _ in docs:
        tokens[source, lang or "(none)", kind] += len(text.split())
    scale = dict.fromkeys(tokens, 1.0)
    for _ in range(rounds):
        for k, d in enumerate(DIMENSIONS):
            had = defaultdict(float)
            for cell in tokens:
                had[cell[k]] += tokens[cell] * min(1.0, scale[cell])
            for cell in tokens:
                scale[cell] *= budget * targets[d][cell[k]] / sum(targets[d].values()) / had[cell[k]]
    return {cell: min(1.0, s) for cell, s in scale.items()}


@pytest.mark.parametrize("few,share", [(True, 0.3), (True, 0.45), (False, 0.45)])
def test_probabilities_and_marginals(spark, monkeypatch, few, share):
    if not few:
        monkeypatch.setattr(mixing, "FEW_CELLS", 0)
        monkeypatch.setattr(mixing, "MAX_ROUNDS", 6)
    docs = rows()
    budget = share * sum(len(r[1].split()) for r in docs)
    df = spark.createDataFrame(docs, SCHEMA)
    cells = calibrated(measured(df, [], topic_col="kind"), tables(spark, TARGETS), budget)
    expected = plain(docs, TARGETS, budget, mixing.MAX_ROUNDS)
    found = {(r.source, r.lang, r.topic): r.probability for r in cells.collect()}
    assert found.keys() == expected.keys() and all(abs(found[c] - p) < 1e-6 for c, p in expected.items())
    assert (max(found.values()) == 1.0) == (share == 0.45)  # at the larger budget a cell gives all it has
    report = mixture_report(cells).collect()
    assert len(report) == 8 and all(r.met for r in report)
    sample = sample_mixture(df, targets=tables(spark, TARGETS), budget=budget, topic_col="kind").collect()
    assert sample[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    size = lambda own: sum(len(r.text.split()) for r in own)
    assert abs(size(sample) / budget - 1) < 0.02
    for d, column in (("source", "source"), ("topic", "kind")):
        for category, target in TARGETS[d].items():
            part = size([r for r in sample if r[column] == category]) / size(sample)
            assert abs(part - target / sum(TARGETS[d].values())) < 0.03


def test_targets_that_cannot_be_met_are_reported(spark):
    docs = rows()
    df = spark.createDataFrame(docs, SCHEMA)
    targets = {**TARGETS, "source": {"web": 0.1, "wiki": 0.1, "code": 9.0}}
    cells = calibrated(measured(df, [], topic_col="kind"), tables(spark, targets), 0.5 * sum(len(r[1].split()) for r in docs))
    report = {(r.dimension, r.category): r for r in mixture_report(cells).collect()}
    assert not report["source", "code"].met and report["source", "code"].tokens < report["source", "code"].goal
    assert all(r.probability > 0.999 for r in cells.where("source = 'code'").collect())


def test_categories_without_a_target_and_a_budget_beyond_all(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    only = {"source": {"web": 1.0}, "lang": {"en": 1.0, "de": 1.0, "(none)": 1.0}, "topic": {"science": 1.0, "sport": 1.0}}
    assert {r.source for r in sample_mixture(df, targets=tables(spark, only), budget=1000, topic_col="kind").collect()} == {"web"}
    assert sample_mixture(df, budget=1e12, topic_col="kind").count() == df.count()


def test_default_budget_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = lambda df: df.selectExpr("sum(size(split(trim(text), '\\\\s+')))").first()[0]
    assert abs(size(sample_mixture(docs)) / (mixing.BUDGET_SHARE * size(docs)) - 1) < 0.1


def test_rows_are_sampled_by_id_and_columns_pass(spark):
    df = spark.createDataFrame([(i % 50, "a b", "en", "a", 1, 2) for i in range(200)], "doc_id long, text string, lang string, source string, _row int, scale int")
    kept = sample_mixture(df)
    assert kept.columns == df.columns
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert set(counts.values()) == {4} and 20 < len(counts) < 50
