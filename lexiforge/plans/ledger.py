"""The event log and its queue: counters, clocks, pages, top-k, budgets, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import predicates as P
from lexiforge.functions import text as X
from lexiforge.operators.paging import budget_prefix as prefix_within
from lexiforge.plans.registry import query
from lexiforge.sources.tables import table

#: The fixed moment that queries about "now" use.
NOW = "2024-01-20 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_type AS kind, count(*) AS items FROM events GROUP BY event_type")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by one key (A1, A2)."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("items"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS line, count(*) AS items FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by several keys, without null keys (A2, A3)."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag is not null").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("items"))


@query("SELECT event_type AS kind, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_success FROM events WHERE event_type <> 'error' GROUP BY event_type")
def last_success_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last success of each kind (A4)."""
    return events(spark, sf_dir).where("event_type <> 'error'").groupBy(F.col("event_type").alias("kind")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_success"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(f"SELECT user_id, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS)} FROM events GROUP BY user_id")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as columns, zeros filled."""
    return events(spark, sf_dir).groupBy("user_id").pivot("event_type", KINDS).count().na.fill(0)


@query(f"""
SELECT event_type, count(*) FILTER (WHERE ts > n - INTERVAL 5 MINUTE) AS five_minutes, count(*) FILTER (WHERE ts > n - INTERVAL 15 MINUTE) AS quarter,
  count(*) FILTER (WHERE ts > n - INTERVAL 1 HOUR) AS hour, count(*) FILTER (WHERE ts > n - INTERVAL 1 DAY) AS day, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest
FROM events, (SELECT TIMESTAMP '{NOW}' AS n) WHERE ts <= n GROUP BY event_type""")
def trailing_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in trailing half-open windows, in one pass."""
    since = lambda span: F.count_if(F.col("ts") > now() - F.expr(f"INTERVAL {span}"))
    past = events(spark, sf_dir).where(F.col("ts") <= now())
    return past.groupBy("event_type").agg(since("5 MINUTE").alias("five_minutes"), since("15 MINUTE").alias("quarter"), since("1 HOUR").alias("hour"), since("1 DAY").alias("day"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("""
WITH last AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 10000)
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS code, count(*) AS failures FROM last WHERE event_type = 'error' GROUP BY code ORDER BY failures DESC, code LIMIT 50""")
def recent_failures_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent codes of the last 10 000 events."""
    last = events(spark, sf_dir).orderBy(F.desc("event_id")).limit(10_000)
    codes = last.where("event_type = 'error'").groupBy(F.get_json_object("props", "$.k").cast("long").alias("code")).agg(F.count("*").alias("failures"))
    return codes.orderBy(F.desc("failures"), "code").limit(50)


@query("""
SELECT o_orderpriority AS profile, count(*) AS total, CAST(sum(CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS future,
  CAST(sum(CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS ready, strftime(min(o_orderdate), '%Y-%m-%d') AS next_at
FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority""")
def conditional_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready is the total less the future ones; the earliest time in the same pass."""
    late = F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")
    sums = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("profile")).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.when(late, 1).otherwise(0)), F.lit(0)).alias("future"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("next_at"))
    return sums.withColumn("ready", F.col("total") - F.col("future"))


@query("""
WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderstatus AS state, CAST(sum(n) AS BIGINT) AS items, count(*) AS groups FROM c GROUP BY o_orderstatus""")
def counted_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over counters that are kept by group."""
    counters = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return counters.groupBy(F.col("o_orderstatus").alias("state")).agg(F.sum("n").alias("items"), F.count("*").alias("groups"))


@query("""
SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys, to_json(list({'k': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey))::VARCHAR AS json FROM orders GROUP BY o_custkey""".replace("list(o_orderkey ORDER BY o_orderkey) AS keys, ", ""))
def ordered_json_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children as an ordered JSON array (A13, X9); an author's works are few."""
    works = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("a"))
    return works.select("o_custkey", F.coalesce(F.to_json("a"), F.lit("[]")).alias("json"))


@query("""
SELECT o_custkey, o_orderkey AS latest, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def argmax_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, least id first among equals, by one aggregation."""
    best = F.max(F.struct("o_orderdate", F.negate("o_orderkey").alias("back"), "o_totalprice")).alias("best")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", F.negate("best.back").alias("latest"), "best.o_totalprice")


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) - 1 AS repeats FROM documents GROUP BY hash")
def first_position_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrence and repeats of each text."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_id"), (F.count("*") - 1).alias("repeats"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 700 ORDER BY c_custkey LIMIT 26")
def keyset_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 25 behind a cursor, and one row more to tell whether there is another (T5)."""
    keys = [("c_custkey", True)]
    return table(spark, sf_dir, "customer").where(P.after(keys, [700])).orderBy(*P.in_order(keys)).limit(26).select("c_custkey", "c_name")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 5000) ORDER BY o_custkey, o_orderkey LIMIT 40")
def keyset_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind a cursor of two keys."""
    keys = [("o_custkey", True), ("o_orderkey", True)]
    return table(spark, sf_dir, "orders").where(P.after(keys, [100, 5000])).orderBy(*P.in_order(keys)).limit(40).select("o_custkey", "o_orderkey")


@query("""
SELECT l_quantity, l_returnflag, l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_quantity < 40 OR (l_quantity = 40 AND (l_returnflag > 'N' OR (l_returnflag = 'N' AND (l_orderkey > 900 OR (l_orderkey = 900 AND l_linenumber > 2)))))
ORDER BY l_quantity DESC, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 60""")
def keyset_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind a cursor of four keys in mixed directions."""
    keys = [("l_quantity", False), ("l_returnflag", True), ("l_orderkey", True), ("l_linenumber", True)]
    page = table(spark, sf_dir, "lineitem").where(P.after(keys, [40.0, "N", 900, 2])).orderBy(*P.in_order(keys), "l_partkey", "l_suppkey").limit(60)
    return page.select("l_quantity", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH h AS (SELECT max(event_id) AS high FROM events),
p AS (SELECT event_id, event_type FROM events, h WHERE event_id > 300 AND event_id <= high AND event_type IN ('purchase', 'signup') ORDER BY event_id LIMIT 250)
SELECT event_id, event_type, CASE WHEN count(*) OVER () = 250 THEN max(event_id) OVER () ELSE high END AS cursor FROM p, h""")
def log_page_hwm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the log up to a high-water mark, with the next cursor."""
    high = events(spark, sf_dir).agg(F.max("event_id").alias("high"))  # one row
    page = events(spark, sf_dir).where("event_id > 300 and event_type in ('purchase', 'signup')").crossJoin(F.broadcast(high)).where("event_id <= high").orderBy("event_id").limit(250)
    tail = page.agg(F.when(F.count("*") == 250, F.max("event_id")).otherwise(F.max("high")).alias("cursor"))
    return page.select("event_id", "event_type").crossJoin(F.broadcast(tail))


@query("SELECT doc_id, n_chars, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS running FROM documents) WHERE running <= 200000")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order as long as their sizes fit a budget, without those that alone exceed it."""
    return prefix_within(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 200_000)


@query("SELECT hash FROM (SELECT sha256(text) AS hash FROM documents UNION SELECT sha256(text) FROM benchmark)")
def union_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of either table once."""
    hashes = lambda name: table(spark, sf_dir, name).select(F.sha2("text", 256).alias("hash"))
    return hashes("documents").union(hashes("benchmark")).distinct()


@query("SELECT o_custkey FROM (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) ORDER BY m DESC, o_custkey LIMIT 100")
def distinct_order_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys ordered by a column that isn't selected, as an aggregate (U4, A10)."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("m")).orderBy(F.desc("m"), "o_custkey").limit(100).select("o_custkey")


@query("""
SELECT * FROM (SELECT 'bound' AS mode, o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'open' AS mode, o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1)""")
def oldest_of_each_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each arm, so that neither is sorted whole."""
    first = lambda mode, state: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == state).orderBy("o_orderdate", "o_orderkey").limit(1).select(F.lit(mode).alias("mode"), "o_orderkey")
    return first("bound", "P").unionByName(first("open", "O"))


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '{NOW}' AND ts <= TIMESTAMP '{NOW}') WHERE r = 1")
def newest_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key that has not expired."""
    live = events(spark, sf_dir).where((F.col("ts") + F.expr("INTERVAL 7 DAY") > now()) & (F.col("ts") <= now()))
    return live.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("""
SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'succeeded' WHEN bool_or(o_orderstatus = 'P') THEN 'pending' ELSE 'terminal' END AS best FROM orders GROUP BY o_custkey""")
def state_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best state of each key by rank."""
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("r"))
    return best.select("o_custkey", F.when(F.col("r") == 3, "succeeded").when(F.col("r") == 2, "pending").otherwise("terminal").alias("best"))


@query("SELECT user_id, CAST(least(sum(CAST(value * 100 AS BIGINT)), 30000) AS BIGINT) AS remaining FROM events GROUP BY user_id")
def saturating_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that stop at a maximum."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.least(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(30000)).alias("remaining"))


@query("""
SELECT o_custkey, max(o_totalprice) FILTER (WHERE true) AS top, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN max(o_orderkey) END AS epoch FROM orders GROUP BY o_custkey""")
def epoch_if_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum where no target is missing, else null."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.when(F.count_if(F.col("o_orderstatus") == "P") == 0, F.max("o_orderkey")).alias("epoch"))


@query("""
SELECT l_suppkey AS lane, CAST(sum(l_quantity) AS BIGINT) AS done, strftime(max(l_shipdate), '%Y-%m-%d') AS last_success,
  CASE WHEN max(l_shipdate) < TIMESTAMP '2001-11-01' THEN 'stalled' WHEN count(*) FILTER (WHERE l_linestatus = 'O') > count(*) FILTER (WHERE l_linestatus = 'F') THEN 'waiting' ELSE 'running' END AS state
FROM lineitem GROUP BY l_suppkey""")
def lane_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, last success and state of each lane."""
    lanes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("lane")).agg(F.sum("l_quantity").cast("long").alias("done"), F.max("l_shipdate").alias("last"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    state = F.when(F.col("last") < F.lit("2001-11-01").cast("timestamp_ntz"), "stalled").when(F.col("o") > F.col("f"), "waiting").otherwise("running")
    return lanes.select("lane", "done", F.date_format("last", "yyyy-MM-dd").alias("last_success"), state.alias("state"))


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1) // 2 AS BIGINT) AS chunk FROM orders""")
def chunks_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups cut into chunks of two."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.floor((F.row_number().over(w) - 1) / 2).alias("chunk"))


@query("SELECT 'customer' AS name, count(*) AS items FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'all', (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table and of all."""
    counts = table(spark, sf_dir, "customer").agg(F.lit("customer").alias("name"), F.count("*").alias("items")).union(table(spark, sf_dir, "orders").agg(F.lit("orders"), F.count("*")))
    return counts.rollup("name").agg(F.sum("items").alias("items")).select(F.coalesce("name", F.lit("all")).alias("name"), "items")


@query("""
SELECT p_brand, p_type, count(DISTINCT p_size) AS models, max(p_retailprice) AS priority, min(p_partkey) AS first_seen FROM part GROUP BY ALL ORDER BY priority DESC, first_seen LIMIT 50""")
def grouped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by composite key, best first."""
    groups = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count_distinct("p_size").alias("models"), F.max("p_retailprice").alias("priority"), F.min("p_partkey").alias("first_seen"))
    return groups.orderBy(F.desc("priority"), "first_seen").limit(50)


@query("""
WITH o AS (SELECT user_id, event_type, CAST(value AS BIGINT) AS priority, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, event_type, max(priority) AS priority, count(*) AS seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM o GROUP BY ALL""".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def monotone_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that upserts keeping the larger priority leave: a fold that needs no order."""
    demands = events(spark, sf_dir).select("user_id", "event_type", F.floor("value").alias("priority"), "ts")
    return demands.groupBy("user_id", "event_type").agg(F.max("priority").alias("priority"), F.count("*").alias("seen"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("SELECT item_id, sha256(text) AS hash FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an insert would add: those whose key isn't there."""
    new = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("hash"))
    return new.join(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash")), "hash", "left_anti")


@query("""
WITH c AS (SELECT user_id, event_id, event_type, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER w, true) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS batch FROM c)
SELECT user_id, CAST(batch AS BIGINT) AS batch, min(event_type) AS event_type, count(*) AS size FROM b GROUP BY user_id, batch""")
def change_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches end where an attribute changes."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    changed = P.differs(F.col("event_type"), F.lag("event_type").over(w))
    batches = events(spark, sf_dir).withColumn("changed", changed.cast("int")).withColumn("batch", F.sum("changed").over(w))
    return batches.groupBy("user_id", "batch").agg(F.min("event_type").alias("event_type"), F.count("*").alias("size"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'purchase'))
SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN k + (k - 1) // 3 ELSE k * 4 END AS slot FROM r""")
def burst_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of one lane, then one of the other."""
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    ranked = events(spark, sf_dir).where("event_type in ('view', 'purchase')").withColumn("k", k.cast("long"))
    return ranked.select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("k") + F.expr("(k - 1) div 3")).otherwise(F.col("k") * 4).alias("slot"))


@query("SELECT event_id, least(3600.0, 5 * pow(2.0, least(CAST(json_extract(props, '$.k') AS BIGINT) % 12, 10))) AS delay FROM events WHERE event_type = 'error'")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped exponential delays."""
    attempt = F.get_json_object("props", "$.k").cast("long") % 12 + 1
    return events(spark, sf_dir).where("event_type = 'error'").select("event_id", X.backoff(attempt, 5.0, 3600.0, 10).alias("delay"))


@query("""
WITH g AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS island FROM events),
s AS (SELECT user_id, island, count(*) AS failures FROM g WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, max(failures) AS longest, max(failures) >= 3 AS opened FROM s GROUP BY user_id""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of failures of each origin, and whether it opens the circuit (ST7)."""
    failed = (F.col("event_type") == "error").alias("failed")
    ranked = events(spark, sf_dir).select("user_id", "event_id", failed)
    island = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "failed").orderBy("event_id"))
    runs = ranked.withColumn("island", island).where("failed").groupBy("user_id", "island").agg(F.count("*").alias("failures"))
    return runs.groupBy("user_id").agg(F.max("failures").alias("longest"), (F.max("failures") >= 3).alias("opened"))


@query("""
SELECT user_id, count(*) AS halvings FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE event_type = 'error') WHERE gap <= INTERVAL 12 HOUR GROUP BY user_id""")
def ambiguity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that follow another within the window (ST8)."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events(spark, sf_dir).where("event_type = 'error'").withColumn("gap", gap).where(F.col("gap") <= F.expr("INTERVAL 12 HOUR")).groupBy("user_id").agg(F.count("*").alias("halvings"))


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1998-06-01' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'lease_expired_urgent' ELSE 'lease_expired' END ELSE 'leased' END AS code FROM orders WHERE o_orderstatus = 'P'""")
def lease_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases that have run out, with their code (ST5)."""
    ended = F.col("o_orderdate") + F.expr("INTERVAL 30 DAY") <= F.lit("1998-06-01").cast("timestamp_ntz")
    code = F.when(~ended, "leased").when(F.col("o_orderpriority") == "1-URGENT", "lease_expired_urgent").otherwise("lease_expired")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", code.alias("code"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 64")
def claim_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next work to claim under optional filters (ST6, F11, T2)."""
    wanted = P.all_of(*P.optional_filters(o_orderstatus="O", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None))
    return table(spark, sf_dir, "orders").where(wanted).orderBy(F.desc("o_orderpriority"), "o_orderdate", "o_orderkey").limit(64).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("""
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'acknowledge' WHEN n < 3 THEN 'retry' ELSE 'wake' END AS outcome
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def outbox_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each outbox row (ST9)."""
    open_items = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").join(open_items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.when(F.col("n").isNull(), "acknowledge").when(F.col("n") < 3, "retry").otherwise("wake").alias("outcome"))


@query(f"""
WITH e AS (SELECT event_id, user_id FROM events WHERE ts + INTERVAL 3 DAY <= TIMESTAMP '{NOW}' ORDER BY ts, event_id LIMIT 500)
SELECT user_id, count(*) AS pruned FROM e GROUP BY user_id""")
def ttl_prune_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bounded page of expired rows, counted by scope (ST10)."""
    page = events(spark, sf_dir).where(F.col("ts") + F.expr("INTERVAL 3 DAY") <= now()).orderBy("ts", "event_id").limit(500)
    return page.groupBy("user_id").agg(F.count("*").alias("pruned"))


@query("SELECT user_id, event_type AS milestone, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each key and milestone (ST11)."""
    return events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("milestone")).agg(F.min("event_id").alias("event_id"))


@query("""
WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total, max(value) AS top FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN errors * 4 > total THEN 'blocked' WHEN errors * 5 > total THEN 'degraded' ELSE 'healthy' END AS state,
  array_to_string(list_sort(list_filter([CASE WHEN errors * 4 > total THEN 'failures' END, CASE WHEN total < 55 THEN 'idle' END, CASE WHEN top > 400 THEN 'burst' END], lambda x: x IS NOT NULL)), ',') AS blockers FROM n""")
def health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockers by rules, and the state that they make."""
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("total"), F.max("value").alias("top"))
    codes = F.array_compact(F.array(F.when(F.expr("errors * 4 > total"), "failures"), F.when(F.col("total") < 55, "idle"), F.when(F.col("top") > 400, "burst")))
    state = F.when(F.expr("errors * 4 > total"), "blocked").when(F.expr("errors * 5 > total"), "degraded").otherwise("healthy")
    return n.select("user_id", state.alias("state"), F.array_join(F.array_sort(F.array_distinct(codes)), ",").alias("blockers"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' AND k < 20 THEN 'quota_wait' WHEN event_type = 'error' THEN 'retry_wait' WHEN k > 90 THEN 'blocked' ELSE 'admitted' END AS state,
  CASE WHEN event_type = 'error' THEN k * 60 ELSE 0 END AS retry_after
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def admission_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain of gates, most important first."""
    rows = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    error = F.col("event_type") == "error"
    state = F.when(error & (F.col("k") < 20), "quota_wait").when(error, "retry_wait").when(F.col("k") > 90, "blocked").otherwise("admitted")
    return rows.select("event_id", state.alias("state"), F.when(error, F.col("k") * 60).otherwise(0).alias("retry_after"))


@query("""
WITH h AS (SELECT user_id, event_id, value, CASE WHEN value > 100 THEN 1 WHEN value < 20 THEN 0 END AS edge FROM events),
g AS (SELECT *, count(edge) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM h)
SELECT user_id, event_id, coalesce(max(edge) OVER (PARTITION BY user_id, run), 0) = 1 AS pressed FROM g""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On above one threshold, off below a lower one, else as before."""
    edge = F.when(F.col("value") > 100, 1).when(F.col("value") < 20, 0)
    last = F.last(edge, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events(spark, sf_dir).select("user_id", "event_id", (F.coalesce(last, F.lit(0)) == 1).alias("pressed"))


@query("""
WITH d AS (SELECT user_id, ts, value, lag(ts) OVER w AS t0, lag(value) OVER w AS v0, lag(event_type) OVER w AS e0, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, value - v0 AS done, epoch_us(ts) - epoch_us(t0) AS took FROM d WHERE value >= v0 AND ts > t0 AND e0 = event_type)
SELECT user_id, count(*) AS pairs, CASE WHEN sum(took) >= 600000000 AND sum(done) >= 2 THEN round(sum(done) / (sum(took) / 1000000.0) * 3600, 4) END AS rate FROM p GROUP BY user_id""")
def rate_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate by hour from successive samples of one configuration; null from too few."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = events(spark, sf_dir).select("user_id", "event_type", "value", us.alias("t"), F.lag(us).over(w).alias("t0"), F.lag("value").over(w).alias("v0"), F.lag("event_type").over(w).alias("e0"))
    pairs = d.where("value >= v0 and t > t0 and e0 = event_type").select("user_id", (F.col("value") - F.col("v0")).alias("done"), (F.col("t") - F.col("t0")).alias("took"))
    enough = (F.sum("took") >= 600_000_000) & (F.sum("done") >= 2)
    return pairs.groupBy("user_id").agg(F.count("*").alias("pairs"), F.when(enough, F.round(F.sum("done") / (F.sum("took") / 1e6) * 3600, 4)).alias("rate"))


@query("""
WITH r AS (SELECT user_id, event_id, value, CASE WHEN value < lag(value) OVER w THEN 1 ELSE 0 END AS reset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM r),
l AS (SELECT *, max(segment) OVER (PARTITION BY user_id) AS last FROM s)
SELECT user_id, CAST(last AS BIGINT) AS segment, count(*) AS samples, min(value) AS low, max(value) AS high FROM l WHERE segment = last GROUP BY user_id, last""")
def reset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what follows the last fall of a counter."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    marked = events(spark, sf_dir).withColumn("reset", F.when(F.col("value") < F.lag("value").over(w), 1).otherwise(0)).withColumn("segment", F.sum("reset").over(w))
    last = marked.withColumn("last", F.max("segment").over(Window.partitionBy("user_id"))).where("segment = last")
    return last.groupBy("user_id", "segment").agg(F.count("*").alias("samples"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"""
WITH b AS (SELECT user_id, event_id, value, epoch_us(ts) // 30000000 AS bucket, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 30000000 ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{NOW}'),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bucket DESC) AS k FROM b WHERE r = 1)
SELECT user_id, CAST(bucket AS BIGINT) AS bucket, value FROM k WHERE k <= 256""")
def bucket_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sample of each half minute, the latest 256 of six hours."""
    recent = events(spark, sf_dir).where((F.col("ts") > now() - F.expr("INTERVAL 6 HOUR")) & (F.col("ts") <= now()))
    bucket = F.expr("unix_micros(cast(ts as timestamp)) div 30000000")
    last = recent.groupBy("user_id", bucket.alias("bucket")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("bucket")))
    return last.withColumn("k", k).where("k <= 256").drop("k")
