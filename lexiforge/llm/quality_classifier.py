"""A quality classifier on supervised subword embeddings (operator 5).

Each word and each run of 2 to 4 characters is hashed to one of ``BUCKETS``
learned vectors, as is the fact that a word equals the one before; a text is the
mean of its vectors, and a softmax over that mean gives the probability of label 1. The vectors and the softmax are trained
together by stochastic gradient descent (AdaGrad steps) in numpy, in one Spark
task over at most ``TRAINING_ROWS`` labelled documents, which are chosen by a
hash of their id. Since the output is linear in the mean, scoring needs one
number per bucket; that table of fixed size is all that the tasks receive.

Rows whose ``crc32(id) mod 5`` is 0 are held out: their labels are never read.
Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have no features and get the score of the
bias alone. Null ids are not held out, and have no label. Of several labels of one
id the larger counts, and of several texts of a labelled id the first in order is
learnt from; repeated rows are scored alike. A score of just the threshold is label 1.
Without labelled rows of both kinds every score is the share of label 1 (1 if there
are none); an empty table gives an empty result. Texts are scored whole. Scoring is
one pass without a shuffle; other columns pass, but ones named like the results are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.hashing import blocks, mixed, word_hashes
from lexiforge.llm.storage import settle, table

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
#: The bucket of two different words in a row; that of two equal ones follows.
REPEATED = 17
VECTOR = 8
#: Labelled documents that the classifier is fitted on, at most.
TRAINING_ROWS = 2000
#: Bytes of text whose features are held at a time.
BLOCK = 1 << 19
EPOCHS = 12
RATE = 0.3
FOLDS = 5
THRESHOLD = 0.3


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: the bucket of every feature, one kind after the other, as (buckets, starts, stops) with each text's slice."""
    for data, offsets in blocks(texts, BLOCK):
        words, counts = word_hashes(data, offsets)
        ends = np.cumsum(counts)
        yield (mixed(words, 31) & np.uint64(BUCKETS - 1)).astype(np.int64), ends - counts, ends
        # of a pair of words only whether they are equal: that repeats are told apart, whatever the word
        again = np.concatenate(([0], REPEATED + (words[1:] == words[:-1]))) if len(words) else np.zeros(0, np.int64)
        yield again, np.minimum(ends - counts + 1, ends), ends
        # bytes to code points: the places where no continuation byte stands
        begins = (data & 0xC0) != 0x80
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
        at = np.concatenate(([0], np.cumsum(begins)))[offsets]
        gram = points
        for n in range(2, max(SIZES) + 1):
            gram = gram[:-1] * np.uint64(0x100000001B3) + points[n - 1 :] if len(points) >= n else gram[:0]
            if n in SIZES:
                buckets = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) ^ n
                stops = np.maximum(at[:-1], at[1:] - n + 1)
                yield np.concatenate((buckets, np.zeros(n - 1, np.int64))), at[:-1], np.minimum(stops, len(buckets))


KINDS = 2 + len(SIZES)


def grouped(texts: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The kinds of each block together."""
    kinds = []
    for one in features(texts):
        kinds.append(one)
        if len(kinds) == KINDS:
            yield kinds
            kinds = []


def sparse(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct buckets and their weights, which sum to 1."""
    for kinds in grouped(texts):
        for i in range(len(kinds[0][1])):
            own = [b[s[i] : e[i]] for b, s, e in kinds if e[i] > s[i]]
            if not own:
                yield np.zeros(0, np.int64), np.zeros(0, np.float32)
                continue
            ids, which = np.unique(np.concatenate(own), return_inverse=True)
            weights = np.repeat([1 / len(o) / len(own) for o in own], [len(o) for o in own])
            yield ids, np.bincount(which, weights).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """One number per bucket and a bias, whose mean plus bias is the log odds of label 1."""
    share = float(labels.mean()) if len(labels) else 1.0
    flat = np.zeros(BUCKETS + 1, np.float32)
    flat[-1] = math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share >= 1 else -30.0)
    if not 0 < share < 1:
        return flat
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, VECTOR)).astype(np.float32)
    output = rng.normal(0, 0.5, (VECTOR, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    seen_v, seen_o, seen_b = np.full((BUCKETS, 1), 1e-8, np.float32), np.full((VECTOR, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)).tolist():
            ids, weights = rows[i]
            if not len(ids):
                continue
            own = vectors[ids]
            mean = weights @ own
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1  # the gradient of the loss by the logits
            back = output @ p
            step = np.outer(mean, p)
            seen_o += step * step
            output -= rate * step / np.sqrt(seen_o)
            seen_b += p * p
            bias -= rate * p / np.sqrt(seen_b)
            # every row's step is its weight times one vector
            seen_v[ids, 0] += weights * weights * float(back @ back)
            vectors[ids] = own - rate * (weights / np.sqrt(seen_v[ids, 0]))[:, None] * back
    flat[:-1] = vectors @ (output[:, 1] - output[:, 0])
    flat[-1] = bias[1] - bias[0]
    return flat


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """The model from a bounded sample of the labelled rows that are not held out."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    sample = settle(usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(TRAINING_ROWS))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    # a labelled id may stand on any number of rows: one of them, combined before the shuffle
    rows = rows.groupBy("_id").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"), F.max("_label").alias("_label"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(sparse(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.uint16).tobytes() for i, _ in made], pa.binary()), pa.array([w.tobytes() for _, w in made], pa.binary()), batch.column(2)], ["id", "ids", "weights", "label"])

    def fitted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        # views of the rows' own buffers, in the order of ids: nothing is copied
        view = lambda column, kind: [np.frombuffer(x.as_buffer(), kind) if len(x.as_buffer()) else np.zeros(0, kind) for x in column]
        ids, weights, labels = view(rows["ids"], np.uint16), view(rows["weights"], np.float32), rows["label"].to_numpy()
        order = np.argsort(np.array(rows["id"].to_pylist())).tolist()
        return pa.table({"model": pa.array([train([(ids[i], weights[i]) for i in order], labels[order]).tobytes()], pa.binary())})

    sparse_rows = rows.select(F.col("_id").cast("string"), "_text", "_label").mapInArrow(hashed, "id string, ids binary, weights binary, label int")
    model = sparse_rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fitted, "model binary").first()
    return np.frombuffer(bytes(model[0]), np.float32) if model else train([], np.zeros(0))


def score(text: Column, model: np.ndarray) -> Column:
    """The probability of label 1."""
    flat = model.tobytes()

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        table_ = np.frombuffer(flat, np.float32).astype(np.float64)
        bias, odds = table_[-1], []
        for kinds in grouped(texts):
            total = np.zeros(len(kinds[0][1]))
            n = np.zeros(len(kinds[0][1]))  # kinds that the text has
            for buckets, starts, stops in kinds:
                sums = np.concatenate(([0.0], np.cumsum(table_[buckets])))
                own = np.maximum(stops - starts, 0)
                total += np.where(own > 0, sums[np.maximum(stops, starts)] - sums[starts], 0.0) / np.maximum(own, 1)
                n += own > 0
            odds.append(total / np.maximum(n, 1) + bias)
        x = np.concatenate(odds) if odds else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(x, -500, 500))), pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with the score and the predicted label."""
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = docs.withColumn(score_col, score(F.col(text_col), model))
    return scored.withColumn(predicted_col, (F.col(score_col) >= THRESHOLD).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
