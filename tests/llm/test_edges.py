"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge.llm import decontamination, exact_dedup, html_wrapper, importance_resampling, jaccard_join, mixing, quality_classifier, quality_rules, secret_scan, sentence_pieces, token_counts, url_filter

LONG = "alpha beta gamma delta epsilon " * 20_000 + "token = abcdef123456"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves, as columns of the input.
CLASHING = "id long, key long, n long, ids binary, label string, row long, digest binary, host string, kept boolean, weight double, probability double, topic string, n_tokens long, sampled boolean, n_words long, group_size long, score double, block long, v long, _id string, words array<string>, base_failed boolean, host_rate double, host_kept boolean"
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t", "en", None, 3),
    (4, "The same text of seven words here", None, "a", 33),
    (5, "the SAME text of seven words here", "en", "a", 33),
    (5, "the SAME text of seven words here", "en", "a", 33),
    (None, "No identifier stands on this row at all", "de", "b", 39),
    (None, None, None, None, None),
    (7, LONG, "en", "b", len(LONG)),
    (8, "ümläut " * 40, "de", "b", 280),
]


def tables(spark, clashing):
    extra = [f.strip().split(" ", 1) for f in CLASHING.split(", ")] if clashing else []
    wide = lambda df: df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in extra])
    return wide(spark.createDataFrame(ROWS, COLUMNS)), wide(spark.createDataFrame([], COLUMNS))


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "clashing"])
def both(request, spark):
    return tables(spark, request.param)


def labels(spark):
    return spark.createDataFrame([(4, 1), (8, 0), (8, None), (None, 1)], "doc_id long, quality int")


MODEL = sentence_pieces.default_model


def counted(docs):
    import public_tokenizers

    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


WHOLE = {
    "secrets": lambda spark, d: secret_scan.scan_secrets(d),
    "classify": lambda spark, d: quality_classifier.classify(d, labels(spark)),
    "rules": lambda spark, d: quality_rules.quality_rules(d),
    "pieces": lambda spark, d: sentence_pieces.encode_and_decode(d, MODEL()),
    "tokens": lambda spark, d: counted(d),
    "urls": lambda spark, d: url_filter.judge_urls(d, url_col="text"),
    "pages": lambda spark, d: html_wrapper.extract_main_text(d, url_col="source", html_col="text", text_col="main"),
    "near": lambda spark, d: jaccard_join.near_duplicates(d),
    "exact": lambda spark, d: exact_dedup.exact_groups(d, exact_dedup.older_half(d)),
    "leaks": lambda spark, d: decontamination.contamination(d, d.limit(3), item_id_col="doc_id", keep_text=True, spans_col="spans"),
    "resampled": lambda spark, d: importance_resampling.resample(d, d.limit(3), percent=50, min_words=1),
}


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_has_a_result(name, spark, both):
    docs, none = both
    assert WHOLE[name](spark, docs).count() == len(ROWS)
    assert WHOLE[name](spark, none).count() == 0


FILTERS = {"exact": exact_dedup.drop_copies, "near": jaccard_join.keep_one_of_each, "mixture": mixing.sample_mixture}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(name, both):
    docs, none = both
    kept = FILTERS[name](docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(ROWS)
    assert FILTERS[name](none).count() == 0


def test_exact_dedup_defined_results(spark, both):
    docs, _ = both
    kept = exact_dedup.drop_copies(docs).select("doc_id").collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 2, 3, 5, 7, 8]
    groups = {r.id: r for r in exact_dedup.exact_groups(docs, exact_dedup.older_half(docs)).where("id in (1, 2, 4, 5)").collect()}
    assert (groups[1].keep_id, groups[1].group_size, groups[4].keep_id, groups[4].group_size) == (2, 3, 5, 3)


def test_near_defined_results(spark, both):
    found = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(both[0]).collect()}
    assert found[1] == (0, 1) and found[3] == (0, 3) and found[4] == (3, 4) and found[5] == (3, 4)


def test_rules_and_tokens_defined_results(spark, both):
    rules = {r.doc_id: r for r in quality_rules.quality_rules(both[0]).collect()}
    assert rules[1].n_words == 0 and rules[1].base_failed and not rules[1].kept
    assert rules[7].n_repeat_words == 100_000
    tokens = {r.doc_id: r for r in counted(both[0]).collect()}
    assert (tokens[1].n_tokens, tokens[1].n_bytes, tokens[1].over_limit, tokens[7].over_limit) == (0, 0, False, True)


def test_classifier_without_labels_of_both_kinds(spark, both):
    one = quality_classifier.classify(both[0], spark.createDataFrame([(4, 1)], "doc_id long, quality int"))
    none = quality_classifier.classify(both[0], spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.predicted for r in one.collect()} == {1} and {r.predicted for r in none.collect()} == {1}


def test_pipeline_on_hard_rows(spark, both, tmp_path):
    labels(spark).withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in zip(("rows", "none"), both):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            path = f"{tmp_path}/{name}-{_}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (name == "rows")


def test_exact_dedup_of_string_ids(spark):
    rows = [("b", "one text"), ("a", "One text"), ("c", "ONE text"), ("d", "another"), ("d", "another"), (None, "another"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((r.doc_id or "", r.text) for r in exact_dedup.drop_copies(docs).collect()) == [("", "alone"), ("c", "ONE text"), ("d", "another")]


@pytest.mark.parametrize("few", [0, 200_000])
def test_exact_dedup_with_and_without_broadcasts(spark, monkeypatch, few):
    monkeypatch.setattr("lexiforge.llm.storage.FEW_ROWS", few)
    rows = [(i % 70, f"Text {i % 40}") for i in range(300)]
    last = {}
    for i, t in rows:
        last[t.lower()] = max(i, last.get(t.lower(), i))
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted((i, t.capitalize()) for t, i in last.items())


def test_a_written_snapshot_screens_later_batches(spark, tmp_path):
    snapshot = spark.createDataFrame([(f"text number {i}",) for i in range(500)] + [(None,)], "text string")
    exact_dedup.write_snapshot(snapshot, str(tmp_path / "snapshot"))
    batch = spark.createDataFrame([(f"TEXT number {i}", i) for i in range(490, 520)] + [("", 1), (None, 2), ("new", 3)], "text string, _digest int")
    found = exact_dedup.known_texts(batch, str(tmp_path / "snapshot"))
    assert found.columns == ["text", "_digest", "known"]
    assert {r.text for r in found.where("known").collect()} == {f"TEXT number {i}" for i in range(490, 500)} | {"", None}
    assert exact_dedup.known_texts(batch.limit(0), str(tmp_path / "snapshot")).count() == 0
