"""A backfill over an old log that may stop at any batch and goes on where it was.

Progress is a row for each kind of event in the stream's own state: it is committed with the
batch, so it can't run ahead of the rows or behind them. It is read back from the state of the
last committed batch; nothing else keeps it. The end of the log is captured before the first
batch; events behind it belong to the next run.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def split_log(events: DataFrame, folder: str, files: int) -> tuple[int, int]:
    """The log as ``files`` files, for a source that takes one at a time; returns its last event_id and its length."""
    events.repartitionByRange(files, "event_id").write.mode("error").parquet(folder)
    return tuple(events.agg(F.coalesce(F.max("event_id"), F.lit(-1)), F.count("*")).first())


def backfill(spark: SparkSession, source: str, schema: StructType, folder: str, end: int, batches: int | None = None, wait: float = 600) -> bool:
    """Takes what is left of the log up to ``end``, or stops after ``batches`` files of it; true if it ran to the end.

    Changed rows of progress go to ``folder/changes``, by batch; a batch that is run again takes its own place.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).where(F.col("event_id") <= end)
    counted = log.groupBy("event_type").agg(F.max("event_id").alias("cursor"), F.count("*").alias("processed"), F.sum(F.get_json_object("props", "$.k").isNull().cast("long")).alias("invalid"))
    start = last_batch(spark, folder)
    running = counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").foreachBatch(write)
    if batches is None:
        running.trigger(availableNow=True).start().awaitTermination()
        return True
    stream, until = running.start(), time.monotonic() + wait
    try:
        while (now := last_batch(spark, folder)) < start + batches and time.monotonic() < until:
            if stream.exception() is not None:
                raise stream.exception()
            if now >= 0 and not stream.status["isDataAvailable"] and not stream.status["isTriggerActive"]:
                break  # the log has ended
            time.sleep(0.05)
    finally:
        stream.stop()
    return False


def last_batch(spark: SparkSession, folder: str) -> int:
    """The number of the last committed batch; -1 if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/offsets/commits")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return -1
    names = [f.getPath().getName() for f in files.listStatus(path)]  # Spark keeps the last hundred
    return max((int(n) for n in names if n.isdigit()), default=-1)


def progress(spark: SparkSession, folder: str, length: int) -> DataFrame:
    """(event_type, cursor, processed, invalid) by kind, from the state of the last committed batch, and whether all ``length`` events are."""
    state = spark.read.format("statestore").load(f"{folder}/offsets")
    rows = state.select(F.col("key.event_type").alias("event_type"), "value.*").toDF("event_type", "cursor", "processed", "invalid")
    reached = rows.agg((F.coalesce(F.sum("processed"), F.lit(0)) >= length).alias("complete"))
    return rows.crossJoin(reached)  # one row
