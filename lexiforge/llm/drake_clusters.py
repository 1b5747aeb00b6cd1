"""Exact centroid clustering with Drake's adaptive bounds (operator 11).

Vectors become integers, floor(scale * x), so distances and centroids are exact.
Every vector keeps an upper bound of the distance to its own centroid, lower bounds
of the distances to the next nearest ones in order, and one lower bound for all the
rest. A round moves the bounds by how far the centroids moved. Where the upper bound
is below all others the vector stays; else its own distance is computed anew; else
only as many of the ordered centroids are measured as may have come nearer; and only
where the bound of the rest doesn't hold either are all centroids measured. Stored
bounds are rounded outwards and compared strictly, so ties are always measured and go
to the smaller number: the result is that of measuring everything in every round.

How many ordered bounds are kept adapts: a quarter of the centroids at first, then as
many as 99 in 100 vectors needed in the last round, an eighth of the centroids at least.

Each round reads the vectors with their bounds from a table in the shared folder and
writes the next one, so lost tasks are done again from there; the table before is
removed. Sums by centroid are combined before the shuffle; only centroids (``k`` rows)
reach the driver.

Defined results: null vectors, vectors of another length and such with a null, a NaN,
an infinity or a component of ``LARGEST`` or more (whose distances might leave the
range of long) are left out. Start vectors are those of the least hash; equal hashes
(repeated ids) are ordered by vector, null ids come last. With fewer vectors than
``k`` there are as many centroids as vectors. Repeated rows count as often as they
stand and get the same cluster; vectors as near to two centroids belong to that of the
smaller number. Centroids without vectors stay. An empty table gives an empty result.
Other columns pass through (texts of any length too, untouched); the vector column is
left out, and cluster and distance replace columns of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiforge.llm.components import Rounds
from lexiforge.llm.storage import settle, table, unused

#: Components, times the scale, are below this; squared distances then fit in a long.
LARGEST = 1 << 27
#: Part of the vectors that the kept bounds must have sufficed for.
SUFFICED = 0.99
#: Vectors that are measured at a time.
AT_A_TIME = 2048
#: Relative slack of stored bounds; beyond the rounding of a float.
OUTWARD = 2e-7
#: The stored state of a vector.
STATE = {
    "own": T.IntegerType(), "upper": T.FloatType(), "near": T.ArrayType(T.ShortType()), "lower": T.ArrayType(T.FloatType()), "rest": T.FloatType(),
    "need": T.ShortType(), "measured": T.LongType(), "distance": T.LongType(),
}


def quantised(vectors: DataFrame, vec_col: str, x: str, components: int, scale: int) -> DataFrame:
    """``vectors`` of the right shape, the vector column replaced by ``x``, an array of integers."""
    vector = F.col(vec_col).cast("array<double>")
    fits = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * scale < LARGEST), F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(c * scale).cast("int"))
    return vectors.where((F.size(vec_col) == components) & fits).withColumn(x, whole).drop(vec_col)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact, of each row to each of its centroids (n, m, components)."""
    apart = x[:, None, :] - centroids
    return np.einsum("nmc,nmc->nm", apart, apart)


class Bounds:
    """The state of a batch of vectors, by column."""

    def __init__(self, n: int, kept: int):
        self.own, self.upper, self.rest = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        self.near, self.lower = np.zeros((n, kept), np.int64), np.full((n, kept), np.inf)
        #: How many of the others had to be measured in this round, and distances measured in all rounds.
        self.need, self.measured = np.zeros(n, np.int64), np.zeros(n, np.int64)
        #: The squared distance to the own centroid.
        self.distance = np.zeros(n, np.int64)

    @classmethod
    def read(cls, columns: dict[str, pa.Array], kept: int) -> Bounds:
        """The stored bounds, of which the last ordered ones are given up where fewer are kept now."""
        found = cls(len(columns["own"]), 0)
        found.own, found.upper, found.rest = (columns[c].to_numpy().astype(t) for c, t in (("own", np.int64), ("upper", float), ("rest", float)))
        near, lower = (flat.reshape(len(found.own), len(flat) // len(found.own)) for flat in (columns[c].flatten().to_numpy() for c in ("near", "lower")))
        found.near, found.lower = near[:, :kept].astype(np.int64), lower[:, :kept].astype(float)
        if kept < lower.shape[1]:
            found.rest = np.minimum(found.rest, lower[:, kept:].min(axis=1))
        found.measured = columns["measured"].to_numpy().copy()
        found.need = np.zeros(len(found.own), np.int64)
        return found

    def rescan(self, rows: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> None:
        """All centroids are measured for ``rows``."""
        kept = self.near.shape[1]
        for at in np.array_split(rows, -(-len(rows) // AT_A_TIME)) if len(rows) else ():
            d = np.stack([((x[at] - c) ** 2).sum(axis=1) for c in centroids], axis=1)
            order = np.argsort(d, axis=1, kind="stable")  # ties in the order of numbers
            ordered = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
            self.own[at], self.upper[at] = order[:, 0], ordered[:, 0]
            self.near[at], self.lower[at] = order[:, 1 : kept + 1], ordered[:, 1 : kept + 1]
            self.rest[at] = ordered[:, kept + 1] if kept + 1 < len(centroids) else np.inf
        self.measured[rows] += len(centroids)

    def move(self, drift: np.ndarray) -> None:
        """Centroids have moved by ``drift`` at most."""
        self.upper = self.upper + drift[self.own]
        self.lower = np.maximum(0, self.lower - drift[self.near])
        self.rest = np.maximum(0, self.rest - drift.max(initial=0))

    def floors(self) -> np.ndarray:
        """For z = 0, 1, ... the least bound of all centroids but the own and the first z ordered ones."""
        every = np.concatenate((self.lower, self.rest[:, None]), axis=1)
        return np.minimum.accumulate(every[:, ::-1], axis=1)[:, ::-1]

    def settle_order(self, x: np.ndarray, centroids: np.ndarray) -> None:
        """Each vector gets the nearest centroid, by as few measurements as certify it."""
        floors = self.floors()
        doubtful = np.flatnonzero(self.upper >= floors[:, 0])
        for at in np.array_split(doubtful, -(-len(doubtful) // AT_A_TIME)) if len(doubtful) else ():
            self.upper[at] = np.sqrt(distances(x[at], centroids[self.own[at], None, :])[:, 0].astype(float)) * (1 + OUTWARD)
        self.measured[doubtful] += 1
        self.need[doubtful] = (floors[doubtful] <= self.upper[doubtful, None]).sum(axis=1)
        kept = self.near.shape[1]
        for z in range(1, kept + 1):
            rows = np.flatnonzero(self.need == z)
            for at in np.array_split(rows, -(-len(rows) // AT_A_TIME)) if len(rows) else ():
                those = np.concatenate((self.own[at, None], self.near[at, :z]), axis=1)
                d = distances(x[at], centroids[those])
                order = np.lexsort((those, d), axis=-1)
                those, d = np.take_along_axis(those, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))
                self.own[at], self.upper[at], self.near[at, :z], self.lower[at, :z] = those[:, 0], d[:, 0], those[:, 1:], d[:, 1:]
            self.measured[rows] += z
        self.rescan(np.flatnonzero(self.need > kept), x, centroids)

    def columns(self) -> list[pa.Array]:
        listed = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))
        outward = lambda a, by: (a * (1 + by)).astype(np.float32)
        return [
            pa.array(self.own.astype(np.int32)), pa.array(outward(self.upper, OUTWARD)), listed(self.near.astype(np.int16), pa.int16()),
            listed(outward(self.lower, -OUTWARD), pa.float32()), pa.array(outward(self.rest, -OUTWARD)), pa.array(self.need.astype(np.int16)), pa.array(self.measured), pa.array(self.distance),
        ]


def assigned(rows: DataFrame, x: str, prefix: str, centroids: list[list[int]], before: list[list[int]] | None, kept: int) -> DataFrame:
    """``rows`` with their bounds after this round; without centroids ``before`` all are measured."""
    passed = [c for c in rows.columns if c not in {prefix + s for s in STATE}]
    schema = T.StructType(rows.select(*(F.col(f"`{c}`") for c in passed)).schema.fields + [T.StructField(prefix + s, kind) for s, kind in STATE.items()])
    now = np.array(centroids, np.int64)
    drift = before and np.sqrt(np.array([sum((a - b) ** 2 for a, b in zip(p, q)) for p, q in zip(before, centroids)], float)) * (1 + OUTWARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            vectors = column(x).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            if drift is None:
                bounds = Bounds(batch.num_rows, kept)
                bounds.rescan(np.arange(batch.num_rows), vectors, now)
            else:
                bounds = Bounds.read({s: column(prefix + s) for s in STATE}, kept)
                bounds.move(drift)
                bounds.settle_order(vectors, now)
            bounds.distance = ((vectors - now[bounds.own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*map(column, passed), *bounds.columns()], schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def moved(rows: DataFrame, x: str, prefix: str, centroids: list[list[int]], kept: int) -> tuple[list[list[int]], int]:
    """The centroids of their vectors' exact floored means, and how many bounds to keep in the next round."""
    sums = ", ".join(f"sum(cast(`{x}`[{i}] AS long))" for i in range(len(centroids[0])))
    more = ", ".join(f"count_if(`{prefix}need` > {b})" for b in range(kept + 1))
    found = rows.groupBy(f"{prefix}own").agg(F.expr("count(*)"), F.expr(f"array({sums})"), F.expr(f"array({more})")).collect()  # a row a centroid
    centroids, n, more = list(centroids), 0, [0] * (kept + 1)
    for own, count, summed, needing in found:
        centroids[own] = [s // count for s in summed]
        n, more = n + count, [a + b for a, b in zip(more, needing)]
    least = min(kept, len(centroids) // 8)
    return centroids, next((b for b in range(least, kept) if more[b] <= (1 - SUFFICED) * n), kept)


def cluster_vectors(
    vectors: DataFrame, k: int, rounds: int, components: int, scale: int, seed: int, id_col: str = "vec_id", vec_col: str = "embedding", cluster_col: str = "cluster", distance_col: str = "distance", measured_col: str | None = None
) -> tuple[DataFrame, list[list[int]]]:
    """The vectors with the number of their centroid and the squared distance to it, and the centroids.

    The ids are only used to draw the first centroids. ``measured_col`` tells how many distances to centroids were measured for a vector in all rounds.
    """
    x, prefix = unused(vectors, "_x"), "_drake"
    while any(c.lower().startswith(prefix) for c in vectors.columns):
        prefix = f"_{prefix}"
    whole = quantised(vectors, vec_col, x, components, scale)
    first = whole.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).asc_nulls_last(), x).limit(k)
    centroids, before, kept = [list(r[0]) for r in first.select(x).collect()], None, 0
    out = [c for c in whole.columns if c not in (x, cluster_col, distance_col, measured_col)]
    if not centroids:
        return whole.select(*out, F.lit(None).cast("int").alias(cluster_col), F.lit(None).cast("long").alias(distance_col), *([F.lit(None).cast("long").alias(measured_col)] if measured_col else [])), []
    kept = min(max(1, k // 4), len(centroids) - 1)
    tables = Rounds(vectors.sparkSession)
    try:
        rows = tables.keep(whole)
        for _ in range(rounds):
            rows = tables.keep(assigned(rows, x, prefix, centroids, before, kept))
            tables.drop_before()
            before = centroids
            centroids, kept = moved(rows, x, prefix, centroids, kept)
        last = assigned(rows, x, prefix, centroids, before, kept)
        extra = [F.col(f"`{prefix}measured`").alias(measured_col)] if measured_col else []
        done = last.select(*(F.col(f"`{c}`") for c in out), F.col(f"`{prefix}own`").alias(cluster_col), F.col(f"`{prefix}distance`").alias(distance_col), *extra)
        return settle(done), centroids
    finally:
        tables.drop()


def op11_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings`` in 40 clusters, with the inertia of each and of all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, centroids = cluster_vectors(vectors, k=40, rounds=5, components=64, scale=256, seed=2)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    both = named.join(inertia, "cluster", "left").select("*", F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia"))  # 40 rows
    return found.join(F.broadcast(both), "cluster")


def oracle(k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same by measuring every distance in every round."""
    near = """SELECT vec_id, x, arg_min(i, [d, i]) AS i, min(d) AS d FROM (
  SELECT v.row, v.vec_id, v.x, c.i, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {c} c) GROUP BY row, vec_id, x"""
    moved = """SELECT i, list(CASE WHEN n IS NULL THEN o ELSE (s - ((s % n) + n) % n) // n END ORDER BY p) AS x FROM (
  SELECT c.i, p, c.x[p] AS o, any_value(n) AS n, any_value(s) AS s FROM {c} c CROSS JOIN range(1, {components} + 1) t(p)
  LEFT JOIN (SELECT i, q, count(*) AS n, sum(x[q])::BIGINT AS s FROM a{r} CROSS JOIN range(1, {components} + 1) u(q) GROUP BY i, q) m ON m.i = c.i AND m.q = p GROUP BY c.i, p, c.x) GROUP BY i"""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {components})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1)::INTEGER AS i, x FROM v ORDER BY sha256('{seed}:' || vec_id), x LIMIT {k})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        steps.append(f"c{r + 1} AS MATERIALIZED ({moved.format(c=f'c{r}', r=r, components=components)})")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.i AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.i)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.i = a.i"""


OP11_SQL = oracle()
