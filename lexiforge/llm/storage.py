"""Small helpers that all operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.sources.checkpoints import ensure_checkpoint_dir, settle  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of a few short columns that are broadcast at most.
FEW_ROWS = 50_000


def gathered(df: DataFrame, rows_a_task: int) -> DataFrame:
    """``df``, which is settled, in as many partitions as its rows need."""
    return df.coalesce(max(1, -(-df.count() // rows_a_task)))


def broadcast_few(df: DataFrame) -> DataFrame:
    """``df``, whose rows are narrow and which is settled, marked for broadcast if it has at most FEW_ROWS; else as it is."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


#: Keys that more rows have than this, and than a HOT_KEYS-th of all rows, are hot.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``; ``rows`` is the column of ``right`` that says how many rows of ``left`` have its key.

    ``right`` has each key once, narrow rows, and is settled. It is broadcast if it has at
    most FEW_ROWS; else its hot keys are, at most HOT_KEYS of ``total`` rows, so a key that
    a large part of ``left`` has does not meet in one task.
    """
    if right.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return left.join(F.broadcast(right.drop(rows)), key, how)
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    is_hot = F.coalesce(F.col(rows) > least, F.lit(False))
    hot = right.where(is_hot)
    if hot.isEmpty():
        return left.join(right.drop(rows), key, how)
    few = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(~is_hot).drop(rows), key, how)
    return few.unionByName(left.join(F.broadcast(hot.drop(rows)), key))
