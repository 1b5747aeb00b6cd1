"""Drake's bounds against measuring everything, on ties, moved clusters and hard rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from lexiforge.llm.drake_clusters import Bounds, cluster_vectors


def plain(rows, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in first]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = {}
        for _, x in kept:
            of.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(c) // len(of[i]) for c in zip(*of[i])] if i in of else old for i, old in enumerate(centroids)]
    return sorted((-1 if i is None else i, *nearest(x)[::-1]) for i, x in kept), centroids


@pytest.mark.parametrize(("k", "spread", "repeats"), [(12, 3.0, 1), (12, 0.2, 1), (40, 1.0, 3), (1, 1.0, 1), (2, 1.0, 1), (500, 1.0, 1)])
def test_bounds_change_nothing(spark, k, spread, repeats):
    draw = np.random.default_rng(k)
    middles = draw.normal(0, spread, (9, 6))
    # few different components, so that many distances tie
    rows = [(int(i), [float(c) for c in np.round(middles[i % 9] + draw.normal(0, 0.5, 6), 1)]) for i in range(300)]
    rows += [(i + 300, rows[0][1]) for i in range(100)] * repeats
    found, centroids = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), k, 4, 6, 10, 2)
    expected, middle = plain(rows, k, 4, 10, 2)
    assert sorted(tuple(r) for r in found.select("vec_id", "cluster", "distance").collect()) == expected
    assert centroids == middle


def test_hard_rows(spark):
    good = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (2, [0.5, -0.5]), (None, [3.0, 4.0]), (5, [100.0, -100.0])]
    bad = [(6, None), (7, []), (8, [1.0]), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (12, [1.0, -float("inf")]), (13, [1e30, 1.0]), (14, [1.0, 2.0, 3.0])]
    schema = "vec_id long, embedding array<float>"
    docs = spark.createDataFrame(good + bad, schema).selectExpr("*", "'kept' AS cluster", "1 AS _x", "2 AS _drakeown", "'other' AS text")
    found, centroids = cluster_vectors(docs, 3, 2, 2, 256, 2)
    assert found.columns == ["vec_id", "_x", "_drakeown", "text", "cluster", "distance"]
    assert sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance) for r in found.collect()) == plain(good, 3, 2, 256, 2)[0]
    none, centroids = cluster_vectors(docs.limit(0), 3, 2, 2, 256, 2)
    assert none.count() == 0 and none.columns == found.columns and centroids == []


def test_fewer_distances_are_measured(spark):
    draw = np.random.default_rng(1)
    middles = draw.normal(0, 5, (40, 8))
    rows = [(int(i), [float(c) for c in middles[i % 40] + draw.normal(0, 0.3, 8)]) for i in range(4000)]
    found, _ = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 40, 5, 8, 256, 2, measured_col="measured")
    mean = found.agg({"measured": "avg"}).first()[0]
    assert 40 <= mean < 0.6 * 6 * 40


def test_floors_and_giving_up_bounds():
    bounds = Bounds(1, 3)
    bounds.lower[:] = [[5.0, 2.0, 7.0]]
    bounds.rest[:] = 6.0
    assert bounds.floors().tolist() == [[2.0, 2.0, 6.0, 6.0]]
