"""The event log as a stream: counters, first events of each key, and concurrency kept as keyed state.

A stream reads files as they come; a run takes what is there by now and ends
(``availableNow``), in batches of a bounded number of files. Offsets are durable
in the checkpoint folder, so a run that is started again continues behind the
last batch. A sink writes each batch under its own number and overwrites it when
the batch is run again, which makes replays harmless.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lexiforge.sources.checkpoints import ensure_checkpoint_dir

#: Successes in a row that double a key's concurrency; a failure halves it.
STREAK, LARGEST = 5, 16


def event_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs over what is there; the rows of all batches, with the number of the ``batch`` that gave them."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    spark = stream.sparkSession
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    schema = StructType(stream.schema.fields).add("batch", "long")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")  # an empty log gives no batch
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the last batch that changed it."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """Counters by key; use with mode ``update``.

    The log has each event once, and a batch that is run again takes its own place, so
    the state is a number a key; ids of events are not kept.
    """
    return events.groupBy(key).agg(F.count("*").alias("items"))


def first_milestones(events: DataFrame, *keys: str) -> DataFrame:
    """One row when a combination of keys is first seen; use with mode ``append``."""
    return events.select(*keys).dropDuplicates([*keys])


def concurrency(events: DataFrame, key: str) -> DataFrame:
    """The concurrency that a key's outcomes so far allow; use with mode ``update``.

    It doubles after STREAK successes and is halved by a failure, and depends on
    the order of events: within a batch, a key's events are put in order of their
    number. The files of a batch bound what is sorted at a time.
    """

    def fold(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit, streak = state.get if state.exists else (1, 0)
        for failed in pd.concat(list(rows)).sort_values("event_id")["failed"]:
            if failed:
                limit, streak = max(1, limit // 2), 0
            elif streak + 1 == STREAK:
                limit, streak = min(LARGEST, 2 * limit), 0
            else:
                streak += 1
        state.update((limit, streak))
        yield pd.DataFrame({key: [keys[0]], "concurrency": [limit], "streak": [streak]})

    outcomes = events.select(key, "event_id", (F.col("event_type") == "error").alias("failed"))
    return outcomes.groupBy(key).applyInPandasWithState(fold, f"{key} long, concurrency long, streak long", "concurrency long, streak long", "update", GroupStateTimeout.NoTimeout)
