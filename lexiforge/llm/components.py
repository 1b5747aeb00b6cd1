"""Connected components by contraction to random neighbours."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.storage import ensure_checkpoint_dir, join_hot, settle


#: Edges that one task joins up, at most.
EDGES_A_TASK = 200_000


class Rounds:
    """Tables of an iteration, written in the shared checkpoint folder.

    A checkpoint keeps the estimated size of the plan behind it, and from join to
    join such estimates are multiplied; a table that is read again has its own.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.n = spark, 0
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        """Removes the folder (or one table's); tables read from it must not be needed any more."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path or self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def drop_before(self) -> None:
        """Removes the table before the last one."""
        self.drop(f"{self.folder}/{self.n - 2}")


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, to): each vertex of all edges of the task, and one vertex of its component."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = parent[up]
            v = up
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent[root(a)] = root(b)
    yield pa.RecordBatch.from_pydict({"v": pa.array(list(parent), pa.int64()), "to": pa.array([root(v) for v in list(parent)], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for all vertices of ``edges`` (a, b: long); vertices share a label if a path joins them.

    In each round every vertex points to the neighbour, or itself, that comes
    first in an order that is drawn anew; edges are carried over to the targets.
    The number of vertices falls by a factor each round, on paths too, so the
    rounds grow with the logarithm of the input. When at most ``EDGES_A_TASK`` edges
    are left, one task joins them up. Groups are combined before the shuffle; the
    edges of hubs are not shuffled by their hub.
    """
    tables, steps = Rounds(edges.sparkSession), []
    try:
        edges = tables.keep(edges.select("a", "b").where("a <> b"))
        if edges.count() > EDGES_A_TASK:
            edges = tables.keep(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        while total := edges.count():
            if total <= EDGES_A_TASK:
                steps.append(tables.keep(edges.coalesce(1).mapInArrow(joined_up, "v long, to long")))
                break
            order = lambda c, k=len(steps): F.xxhash64(F.col(c), F.lit(k))
            near = edges.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("near"), F.count("*").alias("degree"))
            own = F.struct(order("a").alias("o"), F.col("a").alias("v"))
            step = tables.keep(near.select(F.col("a").alias("v"), F.least("near", own)["v"].alias("to"), "degree"))
            steps.append(step.drop("degree"))
            moved = edges
            for end in ("a", "b"):  # edges stand both ways, so a vertex is as often either end
                moved = join_hot(moved, step.select(F.col("v").alias(end), F.col("to").alias(f"{end}2"), "degree"), end, "degree", total)
            edges = tables.keep(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct())
        labels = steps[0].select("v", F.col("to").alias("label")) if steps else edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
        for step in steps[1:]:
            to = step.select(F.col("v").alias("label"), "to")
            labels = labels.join(to, "label", "left").select("v", F.coalesce("to", "label").alias("label"))
        return settle(labels)
    finally:
        tables.drop()
