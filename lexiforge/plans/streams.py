"""The event log's queries as streams that run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.plans.leases import lease_step
from lexiforge.plans.registry import ORACLES, query
from lexiforge.sources.tables import table
from lexiforge.streaming import backfill as B
from lexiforge.streaming import events as S
from lexiforge.streaming import leases as L


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as a pattern the path may be a file or a folder
    return S.event_stream(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)


@query("SELECT event_type, count(DISTINCT event_id) AS items FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that follow the log (ST1, ST2, ST3)."""
    counts = S.running_counts(opened(spark, sf_dir), "event_type")
    return S.latest(S.run_available(counts, "update", S.shared_folder(spark)), "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of each kind (ST11)."""
    first = S.first_milestones(opened(spark, sf_dir), "user_id", "event_type")
    return S.run_available(first, "append", S.shared_folder(spark)).drop("batch")


@query(f"""
WITH s AS (
  SELECT user_id, list_reduce(list_prepend(CAST(10 AS BIGINT), list(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END ORDER BY event_id)),
    lambda s, x: CASE WHEN x < 0 THEN greatest(1, s // 10 // 2) * 10 WHEN s % 10 = {S.STREAK - 1} THEN least({S.LARGEST}, s // 10 * 2) * 10 ELSE s + 1 END) AS s
  FROM events GROUP BY user_id)
SELECT user_id, s // 10 AS concurrency, s % 10 AS streak FROM s""")
def stream_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's concurrency as keyed state (ST14)."""
    kept = S.concurrency(opened(spark, sf_dir), "user_id")
    return S.latest(S.run_available(kept, "update", S.shared_folder(spark)), "user_id")


@query("""
SELECT event_type, max(event_id) AS cursor, count(*) AS processed, 0::BIGINT AS invalid, true AS complete, true AS resumed FROM events GROUP BY event_type""")
def resumed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill in eight files that is stopped after two and goes on; its progress is read from the stream's state (ST2)."""
    events, folder = table(spark, sf_dir, "events"), S.shared_folder(spark)
    end, length = B.split_log(events, f"{folder}/log", 8)
    B.backfill(spark, f"{folder}/log", events.schema, f"{folder}/run", end, batches=2)
    stopped = B.last_batch(spark, f"{folder}/run")
    B.backfill(spark, f"{folder}/log", events.schema, f"{folder}/run", end)
    return B.progress(spark, f"{folder}/run", length).withColumn("resumed", F.lit(0 < stopped < B.last_batch(spark, f"{folder}/run")))


@query(rf"""
{ORACLES["lease_transitions"].split("SELECT user_id, event_id, outcome, epoch FROM s WHERE r > 0")[0]},
o AS (SELECT s.user_id, s.r, s.event_id, s.outcome, s.epoch, s.status, s.expires, n.t, lead(n.t) OVER (PARTITION BY s.user_id ORDER BY s.r) AS next FROM s JOIN n ON n.user_id = s.user_id AND n.r = s.r)
SELECT user_id, event_id, outcome, epoch, t AS at FROM o
UNION ALL SELECT user_id, NULL, 'expired', epoch, expires FROM o WHERE status = 'running' AND expires <= coalesce(next, (SELECT max(epoch_us(ts)) FROM events))""")
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event of the log does to its user's lease, as keyed state of a stream; leases that run out say so by a timer, without an event (ST4, ST5)."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    log = opened(spark, sf_dir).select("user_id", "event_id", "event_type", "ts", t, F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").alias("v"))
    before = spark.conf.get(L.PROVIDER)
    spark.conf.set(L.PROVIDER, L.ROCKS)
    try:
        return S.run_available(L.lease_outcomes(log, "user_id", lease_step), "append", S.shared_folder(spark)).drop("batch")
    finally:
        spark.conf.set(L.PROVIDER, before)
