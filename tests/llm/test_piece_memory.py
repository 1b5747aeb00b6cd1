"""Texts are cut into pieces once, and few at a time; words are hashed few at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiforge.llm import hashing
from lexiforge.llm import sentence_pieces as P


def traced(function):
    tracemalloc.start()
    found = function()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, peak


def test_texts_are_cut_once_and_not_sent_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = P.encode_and_decode(docs, P.default_model())
    assert made.columns == ["doc_id", "text", "piece_ids", "n_pieces", "round_trip"]
    evaluated = [line for line in made._jdf.queryExecution().executedPlan().toString().split("\n") if "ArrowEvalPython" in line]
    assert len(evaluated) == 1 and "pythonUDF1" not in evaluated[0]


def test_slices_change_no_piece(spark, monkeypatch):
    texts = ["", None, "a", "two  words\n", "é語😀 ▁", "x" * 5000, None, "", "the end " * 40]
    monkeypatch.setattr(P, "SLICE_BYTES", 7)
    model = P.piece_model(P.default_model())
    assert [t for few in P.few_at_a_time(pa.array(texts)) for t in few.to_pylist()] == texts
    ids, same = P.cut_and_checked(pa.array(texts), model)
    assert ids.to_pylist() == [np.frombuffer(model.encode(t), np.int32).tolist() for t in texts]
    assert same.to_pylist() == [True] * len(texts)
    ids, same = P.cut_and_checked(pa.array([], pa.string()), model)
    assert ids.to_pylist() == same.to_pylist() == []
    monkeypatch.setattr(model, "encode_all", lambda texts: [P.PieceModel.encode_all(model, ["other"])[0] for _ in texts])
    assert P.cut_and_checked(pa.array(["other", "text", None]), model)[1].to_pylist() == [True, False, False]


def test_results_of_the_query(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "日本 x\n")], "doc_id long, piece_ids string")
    made = P.encode_and_decode(docs, P.default_model(), text_col="piece_ids", ids_col="ids").orderBy("doc_id").collect()
    plain = docs.select("doc_id", P.encoded(F.col("piece_ids"), P.default_model()).alias("ids")).withColumn("text", P.decoded(F.col("ids"), P.default_model())).orderBy("doc_id").collect()
    assert [(r.ids, r.n_pieces, r.round_trip) for r in made] == [(r.ids, len(r.ids), True) for r in plain]
    assert [r.text for r in plain] == ["Hello world", "", "", "日本 x\n"]


def test_memory_of_a_batch():
    model = P.piece_model(P.default_model())
    texts = pa.array([f"some words of text {i % 50} " * 400 for i in range(1200)])
    model.encode_all(texts.slice(0, 50).to_pylist())
    (ids, same), peak = traced(lambda: P.cut_and_checked(texts, model))
    assert all(same.to_pylist()) and len(ids) == 1200
    assert peak < 1.5 * ids.values.nbytes + 40 * P.SLICE_BYTES


def test_memory_of_hashed_words():
    data = np.random.default_rng(5).choice(np.frombuffer(b"abcdefgh   ", np.uint8), hashing.BLOCK_BYTES)
    data[1000:400_000] = 97  # a word longer than the sums that are held
    low, begins, ends = hashing.cut_words(data, np.array([0, 2000, len(data)]))
    found, peak = traced(lambda: hashing.hashes_of(low, begins, ends))
    assert peak < 8 * len(data) + 2 * found.nbytes
    for k in [0, 1, len(begins) - 1, *range(0, len(begins), 50_000)]:
        plain, power = 0, 1
        for byte in low[begins[k] : ends[k]].tolist():
            plain, power = (plain + (byte + 1) * power) % 2**64, power * hashing.BASE % 2**64
        assert hashing.mixed(np.array([plain], np.uint64), 7)[0] == found[k]
