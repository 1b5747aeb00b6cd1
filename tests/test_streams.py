"""Streams that stop and go on, and leases that run out by a timer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiforge.plans.leases import LEASE, lease_step
from lexiforge.streaming import backfill as B
from lexiforge.streaming import events as S
from lexiforge.streaming import leases as L

KIND = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def log(spark, n):
    return spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 5).alias("user_id"), F.element_at(F.array(F.lit("view"), F.lit("error"), F.lit("click")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), F.lit(1.0).alias("value"), F.when(F.col("id") % 7 > 0, F.lit('{"k": 1}')).alias("props"))


def test_a_backfill_that_stops_equals_one_run(spark, tmp_path):
    end, length = B.split_log(log(spark, 300), f"{tmp_path}/log", 6)
    assert (end, length) == (299, 300)
    run = lambda name, batches=None: B.backfill(spark, f"{tmp_path}/log", log(spark, 1).schema, f"{tmp_path}/{name}", end, batches)
    rows = lambda name: sorted(tuple(r) for r in B.progress(spark, f"{tmp_path}/{name}", length).collect())
    assert run("whole")
    assert not run("parts", 2)
    stopped = rows("parts")
    assert sum(r[2] for r in stopped) < length and not any(r[4] for r in stopped)
    assert not run("parts", 1)
    assert run("parts") and rows("parts") == rows("whole")
    assert rows("whole") == [("click", 299, 100, 14, True), ("error", 298, 100, 14, True), ("view", 297, 100, 15, True)]
    assert run("parts") and rows("parts") == rows("whole")  # nothing is left


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(L.PROVIDER)
    spark.conf.set(L.PROVIDER, L.ROCKS)
    yield
    spark.conf.set(L.PROVIDER, before)


def test_leases_run_out_without_an_event(spark, tmp_path, rocks):
    hour, start = 3_600_000_000, 1_700_000_000_000_000
    schema = "user_id long, event_id long, event_type string, t long, k long, v long"
    batches = [
        [(1, 1, "view", 0, 1, 0), (2, 2, "view", 1, 1, 0), (3, 3, "view", 2, 1, 0)],
        [(1, 4, "click", 20, 1, 0), (2, 5, "purchase", 21, 1, 0)],
        [(4, 6, "view", 30, 1, 0)],  # user 3's lease has run out, user 1's was renewed
        [(4, 7, "error", 50, 4, 0), (1, 8, "click", 60, 1, 0)],  # user 1's too; 4's epoch is stated wrongly
    ]
    folder = f"{tmp_path}/log"
    for i, rows in enumerate(batches):
        rows = [(u, e, kind, start + h * hour, k, v) for u, e, kind, h, k, v in rows]
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(f"{schema}, ts timestamp").parquet(folder)
        S.run_available(L.lease_outcomes(stream, "user_id", lease_step), "append", f"{tmp_path}/run")  # stops and goes on
        assert i >= 0
    found = spark.read.parquet(f"{tmp_path}/run/rows").collect()
    said = sorted((r.event_id, r.outcome, r.epoch) for r in found if r.event_id is not None)
    assert said == [(1, "claimed", 1), (2, "claimed", 1), (3, "claimed", 1), (4, "renewed", 1), (5, "succeeded", 1), (6, "claimed", 1), (7, "lost_lease", 1), (8, "lost_lease", 1)]
    ended = sorted((r.user_id, r.epoch, (r.at - start) // hour) for r in found if r.outcome == "expired")
    assert LEASE == 24 * hour and ended == [(1, 1, 44), (3, 1, 26), (4, 1, 54)]
