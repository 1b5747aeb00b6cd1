"""Decision tables over the log and the orders: admission of work, state of origins, state of a monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import decisions as D
from lexiforge.plans.registry import query
from lexiforge.sources.tables import table

# The gates' inputs as they follow from an event (k: the payload's number), the same SQL for both engines.
SIGNALS = {
    "enabled": "k % 17 <> 0", "global_paused": "event_id % 23 = 0", "paid_work_paused": "event_id % 29 = 1", "budget": "CASE WHEN user_id % 31 = 0 THEN 'unarmed' WHEN user_id % 37 = 5 THEN 'exhausted' WHEN user_id % 37 = 6 THEN 'closed' ELSE 'armed' END",
    "resources": "CASE WHEN k = 3 THEN 'waiting' ELSE 'ready' END", "next_probe_at": "event_id + 60", "credentials": "CASE k WHEN 5 THEN 'absent' WHEN 6 THEN 'expired' ELSE 'ready' END", "credentials_retry_at": "event_id + 1",
    "authentication": "CASE WHEN k = 7 THEN 'waiting' END", "authentication_retry_at": "event_id + 2", "quota": "CASE WHEN event_type = 'error' AND k < 20 THEN 'waiting' ELSE 'ready' END", "quota_retry_at": "event_id + k",
    "provider": "CASE WHEN event_type <> 'error' THEN 'ready' WHEN k < 40 THEN 'network_wait' WHEN k < 60 THEN 'rate_limited' WHEN k < 80 THEN 'backoff' ELSE 'starting' END", "provider_retry_at": "event_id + 2 * k",
    "scheduler": "CASE k % 13 WHEN 1 THEN 'circuit_open' WHEN 2 THEN 'error_dampener' WHEN 3 THEN 'launch_pacing' WHEN 4 THEN 'at_capacity' WHEN 5 THEN 'adaptive' ELSE 'steady' END", "next_wake_at": "event_id + 30",
    "selected_concurrency": "k % 4", "configured_concurrency": "2", "active_invocations": "k % 3", "ready_work": "k % 2",
}
FIELDS = ("state", "reason", "recovery", "action", "retry_at")


def signalled(spark: SparkSession, sf_dir: str, signals: dict[str, str], *keep: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select(*keep, *[F.expr(e).alias(n) for n, e in signals.items()])


def signals_sql(signals: dict[str, str], keep: str) -> str:
    return f"SELECT {keep}, {', '.join(f'{e} AS {n}' for n, e in signals.items())} FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def fields_sql(gates: list[D.Gate]) -> str:
    return ", ".join(f"{D.sql(gates, f)}{'::BIGINT' if f == 'retry_at' else ''} AS {f}" for f in FIELDS)


@query(f"WITH s AS ({signals_sql(SIGNALS, 'event_id')}) SELECT event_id, {fields_sql(D.ADMISSION)} FROM s")
def admission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether work is admitted, by a table of gates in order of precedence: state, reason, who can change it, how, and when it is tried again."""
    return signalled(spark, sf_dir, SIGNALS, "event_id").select("event_id", D.decide(D.ADMISSION).alias("d")).select("event_id", "d.*")


STOPS = {
    "configured": "user_id % 41 <> 0",
    "stop_reason": "CASE WHEN event_type <> 'error' THEN '' ELSE CASE k % 9 WHEN 0 THEN 'SOURCE_HUMAN_REQUIRED' WHEN 1 THEN 'CHALLENGE_PAGE_NETWORK' WHEN 2 THEN 'NETWORK_RATE_LIMIT' WHEN 3 THEN 'RATE_LIMITED' WHEN 4 THEN 'DISK_LOW' WHEN 5 THEN 'STORAGE' WHEN 6 THEN 'CAPACITY_X' WHEN 7 THEN 'OTHER' ELSE '' END END",
    "consecutive_failures": "k % 5", "cooldown_until": "1000000 + k * 1000", "next_allowed_at": "CASE WHEN k % 2 = 0 THEN 1090000 ELSE 0 END", "now_ms": "1050000", "runtime_state": "CASE WHEN k % 7 = 0 THEN 'draining' END",
}


@query(f"WITH s AS ({signals_sql(STOPS, 'event_id')}) SELECT event_id, CASE WHEN state = 'as_reported' THEN runtime_state ELSE state END AS state, reason, retry_at FROM (SELECT event_id, runtime_state, {fields_sql(D.ORIGIN)} FROM s)")
def origin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of an origin from the text of the reason for which it stopped, else from its gate, else as reported."""
    decided = signalled(spark, sf_dir, STOPS, "event_id").select("event_id", "runtime_state", D.decide(D.ORIGIN).alias("d"))
    return decided.select("event_id", F.when(F.col("d.state") == "as_reported", F.col("runtime_state")).otherwise(F.col("d.state")).alias("state"), "d.reason", "d.retry_at")


MONITOR_SQL = """
WITH l AS (SELECT user_id, max(event_id) AS last, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY user_id),
d AS (SELECT user_id, CASE WHEN user_id % 19 <> 0 THEN 'writer-' || user_id % 3 END AS document_id, 'writer-' || user_id % 5 % 3 AS expected_id, epoch_ms(ts) AS observed_at, 1705708800000 AS now_ms, 43200000 AS stale_after,
  CASE WHEN errors * 4 > n THEN 1 ELSE 0 END AS blockers, CASE WHEN errors * 5 > n THEN 1 ELSE 0 END AS warnings FROM l JOIN events e USING (user_id) WHERE e.event_id = l.last)
"""


@query(f"{MONITOR_SQL} SELECT user_id, {fields_sql(D.MONITOR)} FROM d")
def monitor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor shows of each user's last event: another writer's, too old, blocked, degraded or healthy."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(ms, "event_id").alias("observed_at"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    signals = {
        "document_id": "CASE WHEN user_id % 19 <> 0 THEN concat('writer-', user_id % 3) END", "expected_id": "concat('writer-', user_id % 5 % 3)", "observed_at": "observed_at", "now_ms": "1705708800000L", "stale_after": "43200000L",
        "blockers": "CASE WHEN errors * 4 > n THEN 1 ELSE 0 END", "warnings": "CASE WHEN errors * 5 > n THEN 1 ELSE 0 END",
    }
    rows = last.select("user_id", *[F.expr(e).alias(n) for n, e in signals.items()])
    return rows.select("user_id", D.decide(D.MONITOR).alias("d")).select("user_id", "d.*")
