"""Leases, gates and upserts as folds of the log; checks of bindings, responses and repeats; budgets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import predicates as P
from lexiforge.functions import text as X
from lexiforge.operators.folds import ordered_fold
from lexiforge.operators.paging import budget_prefix
from lexiforge.plans.registry import query
from lexiforge.sources.tables import table

#: The fixed moment that queries about "now" use.
NOW = "2024-01-20 00:00:00"
DAY = 86_400_000_000
#: Microseconds that a lease holds.
LEASE = DAY
NUMBERED = """n AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, t in microseconds, k, v)."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", t, F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").alias("v"))


def lease_step(state: tuple, row: dict) -> tuple[tuple, dict]:
    """view: claim; click: renew; purchase: succeed; error: fail; signup: enqueue again. Stated epochs are one behind where k is a multiple of 4."""
    status, epoch, expires = state
    kind, t = row["event_type"], row["t"]
    stated = epoch - (row["k"] % 4 == 0)
    if status == "running" and expires <= t:
        status = "pending"  # the lease has run out
    if kind == "signup":
        outcome = "busy" if status == "running" else "queued"
        status = status if status == "running" else "pending"
    elif kind == "view":
        if status == "running" or status == "succeeded":
            outcome = "busy" if status == "running" else "done"
        else:
            status, epoch, expires, outcome = "running", epoch + 1, t + LEASE, "claimed"
    elif status != "running" or stated != epoch:
        outcome = "lost_lease"
    elif kind == "click":
        expires, outcome = t + LEASE, "renewed"
    else:
        status = outcome = "succeeded" if kind == "purchase" else "retry_wait"
    return (status, epoch, expires), {"event_id": row["event_id"], "outcome": outcome, "epoch": epoch}


@query(f"""
WITH RECURSIVE {NUMBERED},
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, 'pending' AS status, CAST(0 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS expires, '' AS outcome FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, r, event_id,
    CASE WHEN event_type = 'signup' THEN CASE WHEN now = 'running' THEN now ELSE 'pending' END WHEN event_type = 'view' THEN CASE WHEN now IN ('running', 'succeeded') THEN now ELSE 'running' END
      WHEN now <> 'running' OR k % 4 = 0 THEN now WHEN event_type = 'click' THEN now WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'retry_wait' END,
    CASE WHEN event_type = 'view' AND now NOT IN ('running', 'succeeded') THEN epoch + 1 ELSE epoch END,
    CASE WHEN event_type = 'view' AND now NOT IN ('running', 'succeeded') THEN t + {LEASE} WHEN event_type = 'click' AND now = 'running' AND k % 4 <> 0 THEN t + {LEASE} ELSE expires END,
    CASE WHEN event_type = 'signup' THEN CASE WHEN now = 'running' THEN 'busy' ELSE 'queued' END WHEN event_type = 'view' THEN CASE now WHEN 'running' THEN 'busy' WHEN 'succeeded' THEN 'done' ELSE 'claimed' END
      WHEN now <> 'running' OR k % 4 = 0 THEN 'lost_lease' WHEN event_type = 'click' THEN 'renewed' WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'retry_wait' END
  FROM (SELECT n.*, s.epoch, s.expires, CASE WHEN s.status = 'running' AND s.expires <= n.t THEN 'pending' ELSE s.status END AS now FROM s JOIN n ON n.user_id = s.user_id AND n.r = s.r + 1))
SELECT user_id, event_id, outcome, epoch FROM s WHERE r > 0""")
def lease_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, renewals and completions under a fence of epoch and expiry: what each event of the log does (ST4, ST5)."""
    return ordered_fold(log(spark, sf_dir), "user_id", ["event_id"], lambda: ("pending", 0, 0), lease_step, "event_id long, outcome string, epoch long")


#: A repeated demand counts as seen again after so long, in microseconds.
TOUCH = 5 * 60_000_000


def touch_step(state: tuple | None, row: dict) -> tuple[tuple, dict | None]:
    priority, seen, touched = state
    if seen is None:
        return (row["v"], row["t"], 0), None
    if row["v"] > priority or row["t"] >= seen + TOUCH:
        return (max(priority, row["v"]), row["t"], touched + 1), {"event_id": row["event_id"], "priority": max(priority, row["v"]), "touched": touched + 1}
    return state, None


@query(f"""
WITH RECURSIVE n AS (SELECT event_type, event_id, epoch_us(ts) AS t, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, user_id FROM events),
s AS (
  SELECT user_id, r, event_id, v AS priority, t AS seen, CAST(0 AS BIGINT) AS touched, false AS wrote FROM n WHERE r = 1
  UNION ALL
  SELECT n.user_id, n.r, n.event_id, CASE WHEN n.v > priority OR n.t >= seen + {TOUCH} THEN greatest(priority, n.v) ELSE priority END, CASE WHEN n.v > priority OR n.t >= seen + {TOUCH} THEN n.t ELSE seen END,
    touched + CAST(n.v > priority OR n.t >= seen + {TOUCH} AS BIGINT), n.v > priority OR n.t >= seen + {TOUCH}
  FROM s JOIN n ON n.user_id = s.user_id AND n.r = s.r + 1)
SELECT user_id, event_id, priority, touched FROM s WHERE wrote""")
def touched_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts that write only for a larger priority or after five minutes."""
    return ordered_fold(log(spark, sf_dir), "user_id", ["event_id"], lambda: (None, None, 0), touch_step, "event_id long, priority long, touched long")


@query("""
WITH f AS (SELECT l_partkey AS slot, o_custkey AS owner, o_orderdate AS seen, l_orderkey, l_linenumber, l_quantity, first_value(o_custkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber) AS first_owner FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT slot, min(first_owner) AS owner, strftime(max(seen) FILTER (WHERE owner = first_owner), '%Y-%m-%d') AS observed, count(*) FILTER (WHERE owner <> first_owner) AS refused FROM f GROUP BY slot""")
def owned_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts that only the first owner of a slot may make; the latest observation stays (U8)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_custkey", "o_orderdate", "l_orderkey", "l_linenumber")
    # combined by owner first: a slot that many write to is a row for each of its owners
    by_owner = rows.groupBy(F.col("l_partkey").alias("slot"), "o_custkey").agg(F.min(F.struct("o_orderdate", "l_orderkey", "l_linenumber")).alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    owner = F.min_by(F.struct("o_custkey", "last", "n"), "first").alias("own")
    slots = by_owner.groupBy("slot").agg(owner, F.sum("n").alias("all"))
    return slots.select("slot", F.col("own.o_custkey").alias("owner"), F.date_format("own.last", "yyyy-MM-dd").alias("observed"), (F.col("all") - F.col("own.n")).alias("refused"))


@query("""
SELECT o_orderkey, 'running' AS state, CAST(o_orderkey % 5 + 1 AS BIGINT) AS epoch, CAST(o_custkey % 3 + 1 AS BIGINT) AS attempts, 'worker-1' AS owner, '1998-06-01 00:15:00' AS expires
FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1998-06-01' AND o_orderpriority IS DISTINCT FROM '5-LOW' AND o_custkey % 3 >= 1
ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 100""")
def claimed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a claim takes, as they are afterwards: running, one epoch and one attempt on (ST6, F11)."""
    wanted = P.all_of(*P.optional_filters(o_orderstatus=["O", "P"], o_clerk=None), P.differs(F.col("o_orderpriority"), F.lit("5-LOW")), F.col("attempts") >= 1, F.col("o_orderdate") <= F.lit("1998-06-01").cast("timestamp_ntz"))
    ready = table(spark, sf_dir, "orders").withColumns({"attempts": F.col("o_custkey") % 3, "epoch": F.col("o_orderkey") % 5}).where(wanted)
    taken = ready.orderBy(F.desc("o_orderpriority"), "o_orderdate", "o_orderkey").limit(100)
    return taken.select("o_orderkey", F.lit("running").alias("state"), (F.col("epoch") + 1).alias("epoch"), (F.col("attempts") + 1).alias("attempts"), F.lit("worker-1").alias("owner"), F.lit("1998-06-01 00:15:00").alias("expires"))


#: Least gap between requests, first and longest cooldown, in microseconds; failures in a row that stop an origin.
GAP, COOLDOWN, LONGEST_COOLDOWN, STOPPED = 3_600_000_000, DAY, 8 * DAY, 5


@query(f"""
WITH {NUMBERED}, p AS (SELECT * FROM n WHERE t <= epoch_us(TIMESTAMP '{NOW}') AND event_type IN ('purchase', 'error')),
g AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS good FROM p GROUP BY user_id),
a AS (SELECT p.user_id, max(t) FILTER (WHERE event_type = 'purchase') AS completed, max(t) FILTER (WHERE event_type = 'error') AS failed_at, count(*) FILTER (WHERE event_type = 'error' AND (good IS NULL OR event_id > good)) AS failures FROM p JOIN g ON g.user_id = p.user_id GROUP BY p.user_id),
u AS (SELECT *, greatest(coalesce(completed + {GAP}, 0), CASE WHEN failures > 0 THEN failed_at + least({LONGEST_COOLDOWN}, {COOLDOWN} * CAST(pow(2, least(failures - 1, 10)) AS BIGINT)) ELSE 0 END) AS retry_at FROM a)
SELECT user_id, failures, CASE WHEN failures >= {STOPPED} THEN 'stopped' WHEN retry_at > epoch_us(TIMESTAMP '{NOW}') THEN 'waiting' ELSE 'claimed' END AS state, CASE WHEN failures < {STOPPED} AND retry_at > epoch_us(TIMESTAMP '{NOW}') THEN retry_at END AS retry_at FROM u""")
def origin_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each origin may be asked now: gap after a success, cooldown after failures in a row, stop after too many (ST7, F23)."""
    now = F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp"))
    past = log(spark, sf_dir).where((F.col("t") <= now) & F.col("event_type").isin("purchase", "error"))
    good, bad = F.col("event_type") == "purchase", F.col("event_type") == "error"
    last = past.where(good).groupBy("user_id").agg(F.max("event_id").alias("good"))
    since = past.join(last, "user_id", "left").groupBy("user_id").agg(
        F.max(F.when(good, F.col("t"))).alias("completed"), F.max(F.when(bad, F.col("t"))).alias("failed_at"), F.count_if(bad & (F.col("good").isNull() | (F.col("event_id") > F.col("good")))).alias("failures")
    )
    cooldown = F.least(F.lit(LONGEST_COOLDOWN), COOLDOWN * F.pow(F.lit(2), F.least(F.col("failures") - 1, F.lit(10))).cast("long"))
    retry = F.greatest(F.coalesce(F.col("completed") + GAP, F.lit(0)), F.when(F.col("failures") > 0, F.col("failed_at") + cooldown).otherwise(0))
    gates = since.withColumn("retry", retry)
    stopped, waiting = F.col("failures") >= STOPPED, F.col("retry") > now
    return gates.select("user_id", "failures", F.when(stopped, "stopped").when(waiting, "waiting").otherwise("claimed").alias("state"), F.when(~stopped & waiting, F.col("retry")).alias("retry_at"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'error'),
h AS (SELECT user_id, count(*) FILTER (WHERE ts - before <= INTERVAL 30 MINUTE) AS halvings, count(*) AS failures FROM e GROUP BY user_id)
SELECT user_id, failures, halvings, greatest(1, 16 >> CAST(least(halvings, 10) AS INT)) AS concurrency FROM h""")
def halved_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concurrency after halvings: each failure within half an hour of another halves it (ST8)."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("near", F.coalesce(gap <= F.expr("INTERVAL 30 MINUTE"), F.lit(False)))
    n = errors.groupBy("user_id").agg(F.count("*").alias("failures"), F.count_if("near").alias("halvings"))
    return n.select("user_id", "failures", "halvings", F.greatest(F.lit(1), F.expr("shiftright(16, cast(least(halvings, 10) as int))")).alias("concurrency"))


@query("""
WITH h AS (SELECT sha256(lower(trim(text))) AS id, lang, source FROM documents), d AS (SELECT id, count(*) AS n, count(DISTINCT (lang, source)) AS kinds FROM h GROUP BY id)
SELECT id, n - 1 AS repeats, CASE WHEN kinds > 1 THEN 'conflict' WHEN n > 1 THEN 'repeated' ELSE 'single' END AS verdict FROM d""")
def conflicting_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of an identity: counted where they agree, a conflict where they don't."""
    rows = table(spark, sf_dir, "documents").select(F.sha2(F.lower(F.trim("text")), 256).alias("id"), F.struct("lang", "source").alias("what"))
    d = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("what").alias("low"), F.max("what").alias("high"))
    return d.select("id", (F.col("n") - 1).alias("repeats"), F.when(P.differs(F.col("low"), F.col("high")), "conflict").when(F.col("n") > 1, "repeated").otherwise("single").alias("verdict"))


@query("""
WITH b AS (SELECT doc_id, text, lang, source, sha256(doc_id || chr(31) || source) AS binding_id, sha256(nfc_normalize(text)) AS line_hash, sha256(nfc_normalize(text) || chr(31) || lang) AS material_hash FROM documents),
p AS (SELECT doc_id, CASE WHEN contains(text, '|') THEN replace(text, '|', '/') ELSE text END AS text, CASE WHEN length(text) > 3000 THEN upper(lang) ELSE lang END AS lang, CASE WHEN starts_with(text, 'A') THEN source || '-moved' ELSE source END AS source, binding_id, line_hash, material_hash FROM b)
SELECT doc_id, CASE WHEN sha256(doc_id || chr(31) || source) <> binding_id THEN 'id_mismatch' WHEN sha256(nfc_normalize(text)) <> line_hash THEN 'line_mismatch' WHEN sha256(nfc_normalize(text) || chr(31) || lang) <> material_hash THEN 'material_mismatch' ELSE 'bound' END AS verdict FROM p""")
def binding_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings whose id, line hash and material hash are computed again from what is presented; the first that differs is named."""
    id_of = lambda: X.identity_hash(F.col("doc_id").cast("string"), F.col("source"))
    nfc = lambda: X.normal(F.col("text"), "NFC")
    made = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", nfc().alias("n")).select("*", id_of().alias("binding_id"), F.sha2("n", 256).alias("line_hash"), X.identity_hash(F.col("n"), F.col("lang")).alias("material_hash"))
    # what is presented differs where the text has a bar, is long, or begins with an A
    shown = made.withColumns({"source": F.when(F.col("text").startswith("A"), F.concat("source", F.lit("-moved"))).otherwise(F.col("source")), "lang": F.when(F.length("text") > 3000, F.upper("lang")).otherwise(F.col("lang")), "text": F.replace("text", F.lit("|"), F.lit("/"))})
    again = shown.withColumn("n", nfc())
    verdict = F.when(id_of() != F.col("binding_id"), "id_mismatch").when(F.sha2("n", 256) != F.col("line_hash"), "line_mismatch").when(X.identity_hash(F.col("n"), F.col("lang")) != F.col("material_hash"), "material_mismatch")
    return again.select("doc_id", F.coalesce(verdict, F.lit("bound")).alias("verdict"))


#: Longest life of a response and largest skew of clocks, in seconds; the moment of the check.
LIFE, SKEW, CHECKED = 3600, 300, "1998-06-01 00:00:00"


@query(f"""
WITH r AS (SELECT o_orderkey AS id, '{{"author":"' || o_custkey || '","targets":[' || (o_orderkey % 11 + 1) || ']}}' AS request, epoch(TIMESTAMP '{CHECKED}')::BIGINT + (o_orderkey % 97) * 60 - 5000 AS observed, o_custkey % 41 * 100 AS life, o_orderkey, o_custkey, o_orderstatus FROM orders),
s AS (SELECT *, sha256(CASE WHEN o_custkey % 13 = 0 THEN request || ' ' ELSE request END) AS scope_hash, observed + life AS expires FROM r),
b AS (SELECT *, '{{"expiresAt":' || expires || ',"observedAt":' || observed || ',"scopeHash":"' || scope_hash || '","state":"' || o_orderstatus || '"}}' AS body FROM s),
m AS (SELECT *, sha256(CASE WHEN o_orderkey % 17 = 0 THEN replace(body, 'state', 'status') ELSE body END) AS manifest_hash FROM b)
SELECT id, CASE WHEN scope_hash <> sha256(request) THEN 'scope_hash_mismatch' WHEN manifest_hash <> sha256(body) THEN 'manifest_hash_mismatch' WHEN expires <= observed OR expires - observed > {LIFE} THEN 'expiry_invalid'
  WHEN observed > epoch(TIMESTAMP '{CHECKED}')::BIGINT + {SKEW} THEN 'observed_in_future' WHEN expires <= epoch(TIMESTAMP '{CHECKED}')::BIGINT THEN 'expired' WHEN o_orderkey % 11 + 1 <> 1 THEN 'scope_invalid' ELSE 'verified' END AS verdict FROM m""")
def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose scope and body are hashed again, and whose times and scope are held against bounds; the first fault is named."""
    now = F.unix_seconds(F.lit(CHECKED).cast("timestamp_ntz").cast("timestamp"))
    request = F.concat(F.lit('{"author":"'), F.col("o_custkey").cast("string"), F.lit('","targets":['), (F.col("o_orderkey") % 11 + 1).cast("string"), F.lit("]}"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", request.alias("request"), (now + F.col("o_orderkey") % 97 * 60 - 5000).alias("observedAt"))
    # scopes and bodies that were changed after they were hashed
    s = r.withColumns({"expiresAt": F.col("observedAt") + F.col("o_custkey") % 41 * 100, "scopeHash": F.sha2(F.when(F.col("o_custkey") % 13 == 0, F.concat("request", F.lit(" "))).otherwise(F.col("request")), 256)})
    body = F.to_json(F.struct("expiresAt", "observedAt", "scopeHash", F.col("o_orderstatus").alias("state")))
    m = s.withColumn("body", body).withColumn("manifestHash", F.sha2(F.when(F.col("o_orderkey") % 17 == 0, F.replace("body", F.lit("state"), F.lit("status"))).otherwise(F.col("body")), 256))
    life, targets = F.col("expiresAt") - F.col("observedAt"), F.size(F.from_json("request", "targets array<long>")["targets"])
    verdict = (
        F.when(F.col("scopeHash") != F.sha2("request", 256), "scope_hash_mismatch").when(F.col("manifestHash") != F.sha2("body", 256), "manifest_hash_mismatch").when((life <= 0) | (life > LIFE), "expiry_invalid")
        .when(F.col("observedAt") > now + SKEW, "observed_in_future").when(F.col("expiresAt") <= now, "expired").when((targets != 1) | (F.get(F.from_json("request", "targets array<long>")["targets"], F.lit(0)) != 1), "scope_invalid")
    )
    return m.select(F.col("o_orderkey").alias("id"), F.coalesce(verdict, F.lit("verified")).alias("verdict"))


@query("""
WITH s AS (SELECT o_orderkey, length('{"key":' || o_orderkey || ',"state":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}') + 1 AS bytes FROM orders),
f AS (SELECT *, sum(bytes) OVER (ORDER BY o_orderkey) AS running, row_number() OVER (ORDER BY o_orderkey) AS r FROM s WHERE bytes <= 6000)
SELECT o_orderkey, CAST(running AS BIGINT) AS running FROM f WHERE running <= 6000 AND r <= 100""")
def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in order under a bound of serialised bytes, commas included, and of their number."""
    item = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority")))
    sized = table(spark, sf_dir, "orders").select("o_orderkey", (F.octet_length(item) + 1).alias("bytes"))
    return budget_prefix(sized, "o_orderkey", "bytes", 6000, items=100).select("o_orderkey", F.col("running").cast("long").alias("running"))


@query("""
WITH g AS (SELECT p_brand, p_type, list_sort(list(DISTINCT p_size)) AS models, max(p_retailprice) AS priority, min(p_partkey) AS first_seen FROM part GROUP BY ALL)
SELECT p_brand, p_type, array_to_string(models, ',') AS models, first_seen FROM g ORDER BY priority DESC, first_seen, p_brand, p_type LIMIT 100""")
def model_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by composite key with the sorted set of their models, best first."""
    groups = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("models"), F.max("p_retailprice").alias("priority"), F.min("p_partkey").alias("first_seen"))
    return groups.orderBy(F.desc("priority"), "first_seen", "p_brand", "p_type").limit(100).select("p_brand", "p_type", F.array_join(F.transform("models", lambda m: m.cast("string")), ",").alias("models"), "first_seen")


@query("SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS code, user_id FROM events WHERE event_type = 'error'")
def distinct_payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of each value in a payload."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(F.get_json_object("props", "$.k").cast("long").alias("code"), "user_id").distinct()


@query("""
WITH c AS (SELECT c_nationkey, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS declared FROM customer)
SELECT c_nationkey, count(*) AS authors, CAST(sum(coalesce(declared, 0)) AS BIGINT) AS declared, count(*) FILTER (WHERE declared IS NULL) AS unknown FROM c GROUP BY c_nationkey""")
def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared counts summed, those that are unknown as 0, and how many are."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")).alias("declared"))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("authors"), F.sum(F.coalesce("declared", F.lit(0))).alias("declared"), F.count_if(F.col("declared").isNull()).alias("unknown"))


@query("""
WITH o AS (SELECT o_orderkey // 64 AS batch, o_orderkey % 64 AS pos, o_orderstatus = 'P' AS bad FROM orders),
l AS (SELECT batch, level, pos >> (6 - level) AS block, bool_or(bad) AS bad FROM o, range(0, 7) AS t(level) GROUP BY ALL)
SELECT batch, CAST(1 + 2 * count(*) FILTER (WHERE bad AND level < 6) AS BIGINT) AS calls, count(*) FILTER (WHERE bad AND level = 6) AS singletons FROM l GROUP BY batch""")
def bisected_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that batches of 64 slots take if a batch with a bad one fails and is cut in two, down to single slots (ST12)."""
    slots = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 64").alias("batch"), (F.col("o_orderkey") % 64).alias("pos"), (F.col("o_orderstatus") == "P").alias("bad"))
    blocks = slots.select("batch", "bad", "pos", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("level")).groupBy("batch", "level", F.expr("shiftright(pos, 6 - level)").alias("block")).agg(F.bool_or("bad").alias("bad"))
    return blocks.groupBy("batch").agg((1 + 2 * F.count_if(F.col("bad") & (F.col("level") < 6))).alias("calls"), F.count_if(F.col("bad") & (F.col("level") == 6)).alias("singletons"))
