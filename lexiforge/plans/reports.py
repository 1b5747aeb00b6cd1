"""Reports and routing: manifests, deltas, capacity with blockers, outcomes with codes, delays with jitter, site maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import predicates as P
from lexiforge.functions.alignment import filled
from lexiforge.plans.alignment import filled_sql
from lexiforge.plans.payloads import UNSAFE_SQL
from lexiforge.plans.registry import query
from lexiforge.sources.sitemaps import CAP, FOOT, HEAD, read_sitemaps, write_sitemaps
from lexiforge.sources.tables import table
from lexiforge.streaming.events import shared_folder

ENTRIES_SQL = r"""e AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS author, regexp_extract(url, '://[^/?#]*(/[a-z]{2}/[0-9]+)(?:[?#]|$)', 1) AS path FROM pages),
k AS (SELECT *, CAST(split_part(path, '/', 3) AS BIGINT) AS number FROM e WHERE path <> '')"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, author, path, number): pages as the records of an author's manifest, here their host's."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("author"), F.regexp_extract("url", r"://[^/?#]*(/[a-z]{2}/[0-9]+)(?:[?#]|\z)", 1).alias("path"))
    return rows.where("path <> ''").withColumn("number", F.split_part("path", F.lit("/"), F.lit(3)).cast("long"))


@query(rf"""
WITH {ENTRIES_SQL},
m AS (SELECT author, count(*) AS n, count(DISTINCT path) AS members, CASE WHEN hash_ = 3 THEN NULL ELSE count(*) + CASE WHEN hash_ = 5 THEN 1 ELSE 0 END END AS declared, string_agg(number, ',' ORDER BY number, path) AS numbers
  FROM (SELECT *, length(author) % 7 AS hash_ FROM k) GROUP BY author, hash_)
SELECT author, CASE WHEN members < n THEN 'SOURCE_POEM_DUPLICATE' WHEN n = 0 AND declared IS DISTINCT FROM 0 THEN 'SOURCE_MANIFEST_UNVERIFIED_EMPTY' WHEN declared <> n THEN 'SOURCE_MANIFEST_COUNT_MISMATCH' ELSE 'complete' END AS verdict, declared::BIGINT AS declared, n AS members, sha256(numbers) AS in_order FROM m""")
def manifest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests by author: duplicates, declared against actual counts, members by number and not by letter."""
    kind = F.length("author") % 7
    ordered = F.array_sort(F.collect_list(F.struct("number", "path")))
    m = entries(spark, sf_dir).groupBy("author").agg(F.count("*").alias("n"), F.count_distinct("path").alias("distinct"), ordered.alias("all"))
    declared = F.when(kind == 3, None).otherwise(F.col("n") + F.when(kind == 5, 1).otherwise(0))
    told = m.withColumn("declared", declared)
    verdict = F.when(F.col("distinct") < F.col("n"), "SOURCE_POEM_DUPLICATE").when((F.col("n") == 0) & P.differs(F.col("declared"), F.lit(0)), "SOURCE_MANIFEST_UNVERIFIED_EMPTY").when(F.col("declared") != F.col("n"), "SOURCE_MANIFEST_COUNT_MISMATCH").otherwise("complete")
    return told.select("author", verdict.alias("verdict"), "declared", F.col("n").alias("members"), F.sha2(F.array_join(F.col("all.number").cast("array<string>"), ","), 256).alias("in_order"))


@query(rf"""
WITH {ENTRIES_SQL},
f AS (SELECT path, min(page_id) AS first, count(*) - 1 AS repeats, count(DISTINCT author) > 1 AS conflict FROM k GROUP BY path),
p AS (SELECT f.*, author, d.doc_id IS NOT NULL AS known, l.doc_id IS NOT NULL AS verified FROM f JOIN e ON e.page_id = f.first LEFT JOIN documents d ON d.doc_id = f.first AND d.doc_id % 3 = 0 LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = f.first)
SELECT author, count(*) FILTER (WHERE known) AS already_in_production, count(*) FILTER (WHERE NOT known AND verified) AS verified_artifacts, count(*) FILTER (WHERE NOT known AND NOT verified) AS seeded, sum(repeats)::BIGINT AS duplicates, count(*) FILTER (WHERE conflict) AS conflicts FROM p GROUP BY author""")
def manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the manifests is new: each record once, less what production has and what is verified already; records that two authors claim are conflicts."""
    k = entries(spark, sf_dir)
    f = k.groupBy("path").agg(F.min_by(F.struct("page_id", "author"), "page_id").alias("own"), (F.count("*") - 1).alias("repeats"), (F.min("author") != F.max("author")).alias("conflict"))
    production = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("known_id"))
    verified = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("verified_id")).distinct()
    joined = f.join(production, F.col("own.page_id") == F.col("known_id"), "left").join(verified, F.col("own.page_id") == F.col("verified_id"), "left")
    known, checked = F.col("known_id").isNotNull(), F.col("verified_id").isNotNull()
    return joined.groupBy("own.author").agg(F.count_if(known).alias("already_in_production"), F.count_if(~known & checked).alias("verified_artifacts"), F.count_if(~known & ~checked).alias("seeded"), F.sum("repeats").alias("duplicates"), F.count_if("conflict").alias("conflicts"))


@query("""
WITH r AS (SELECT c_custkey AS id, c_nationkey FROM customer UNION ALL SELECT -c_custkey, c_nationkey FROM customer WHERE c_custkey % 50 = 0),
w AS (SELECT o_custkey, o_orderstatus AS state, o_orderpriority = '1-URGENT' AS generation FROM orders),
s AS (SELECT id, count(state) AS works, count(*) FILTER (WHERE generation AND state = 'O') AS now_active, count(*) FILTER (WHERE generation AND state = 'F') AS now_done, count(*) FILTER (WHERE generation) AS now_any, count(*) FILTER (WHERE state = 'O') AS active, count(*) FILTER (WHERE state = 'F') AS done, count(*) FILTER (WHERE state = 'P') AS dead, any_value(n_nationkey) AS home
  FROM r LEFT JOIN w ON o_custkey = id LEFT JOIN nation ON n_nationkey = c_nationkey AND id > 0 GROUP BY id),
c AS (SELECT id, CASE WHEN home IS NULL THEN 'unresolved' WHEN now_any > 0 THEN CASE WHEN now_active > 0 THEN 'active' WHEN now_done > 0 THEN 'refreshed' ELSE 'terminal' END WHEN active > 0 THEN 'active' WHEN done > 0 THEN 'needs_refresh' WHEN dead > 0 THEN 'terminal' ELSE 'new' END AS class FROM s)
SELECT class, count(*) AS items, min(id) AS first_member, sha256(string_agg(id, ',' ORDER BY id)) AS members FROM c GROUP BY class""")
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested records by what their work of this and earlier generations says, with the members of each class (P5)."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    requested = customers.union(customers.where("id % 50 = 0").select(-F.col("id"), "c_nationkey")).distinct()
    generation, state = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")
    counts = {"now_active": generation & (state == "O"), "now_done": generation & (state == "F"), "now_any": generation, "active": state == "O", "done": state == "F", "dead": state == "P"}
    work = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    homes = table(spark, sf_dir, "nation").select("n_nationkey")
    rows = requested.join(work, F.col("o_custkey") == F.col("id"), "left").na.fill(0, list(counts)).join(F.broadcast(homes), (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("id") > 0), "left")  # 25 nations
    has = lambda c: F.col(c) > 0
    now = F.when(has("now_active"), "active").when(has("now_done"), "refreshed").otherwise("terminal")
    kind = F.when(F.col("n_nationkey").isNull(), "unresolved").when(has("now_any"), now).when(has("active"), "active").when(has("done"), "needs_refresh").when(has("dead"), "terminal").otherwise("new")
    # members: a digest of digests by ranges would do where a class has many; here it is the list's
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("items"), F.min("id").alias("first_member"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ","), 256).alias("members"))


#: Fixed limits by tier: bytes of a database, and queries of an invocation; the part of either that stays free, in basis points.
TIERS = {"free": (500_000_000, 50), "paid": (10_000_000_000, 1000)}
MARGIN = 1000
#: An action's fixed queries, queries a record and most records.
ACTIONS = {"publish": (6, 9, 50), "verify": (2, 3, 200)}


@query(f"""
WITH t AS (SELECT source, sum(n_chars)::BIGINT AS bytes, count(*) AS rows, count(*) FILTER (WHERE lang = 'en') AS english, min(doc_id) AS low FROM documents GROUP BY source),
l AS (SELECT *, CASE low % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' END AS tier, CASE WHEN rows % 5 <> 0 THEN rows % 60 END AS export_age, rows % 45 AS travel_age, bytes * 1000 AS current FROM t),
b AS (SELECT *, CASE tier WHEN 'free' THEN {TIERS["free"][0]} WHEN 'paid' THEN {TIERS["paid"][0]} END AS most, CASE tier WHEN 'free' THEN {TIERS["free"][1] * (10_000 - MARGIN) // 10_000} WHEN 'paid' THEN {TIERS["paid"][1] * (10_000 - MARGIN) // 10_000} END AS queries, current + rows * 20000 AS projected FROM l),
c AS (SELECT *, least(greatest(0, least({ACTIONS["publish"][2]}, coalesce((queries - {ACTIONS["publish"][0]}) // {ACTIONS["publish"][1]}, 0))), greatest(0, least({ACTIONS["verify"][2]}, coalesce((queries - {ACTIONS["verify"][0]}) // {ACTIONS["verify"][1]}, 0)))) AS chunk FROM b)
SELECT source, projected::BIGINT AS projected, chunk::BIGINT AS chunk, array_to_string(list_sort(list_filter([CASE WHEN tier IS NULL THEN 'TIER_UNKNOWN' END, CASE WHEN current >= most THEN 'CURRENT_DATABASE_OVER_LIMIT' END, CASE WHEN projected > most // 10000 * {10_000 - MARGIN} THEN 'PROJECTED_DATABASE_EXCEEDS_SAFE_LIMIT' END,
  CASE WHEN export_age IS NULL THEN 'BACKUP_PROOF_MISSING' WHEN export_age > 24 THEN 'BACKUP_EXPORT_STALE' END, CASE WHEN export_age IS NOT NULL AND travel_age > 24 THEN 'TIME_TRAVEL_PROOF_STALE' END, CASE WHEN chunk = 0 THEN 'QUERY_BUDGET_EXHAUSTED' END], lambda x: x IS NOT NULL)), ',') AS blockers FROM c""")
def capacity_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source's database will need, the chunk that its query budget allows, and everything that blocks it, in order."""
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count("*").alias("rows"), F.min("doc_id").alias("low"))
    tier = F.when(F.col("low") % 3 == 0, "free").when(F.col("low") % 3 == 1, "paid")
    of_tier = lambda k: F.when(tier == "free", F.lit(TIERS["free"][k])).when(tier == "paid", F.lit(TIERS["paid"][k]))
    told = t.select("source", tier.alias("tier"), (F.col("bytes") * 1000).alias("current"), of_tier(0).alias("most"), F.floor(of_tier(1) * (10_000 - MARGIN) / 10_000).alias("queries"), F.when(F.col("rows") % 5 != 0, F.col("rows") % 60).alias("export_age"), (F.col("rows") % 45).alias("travel_age"), "rows")
    told = told.withColumn("projected", F.col("current") + F.col("rows") * 20_000)
    chunks = [F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.floor((F.col("queries") - fixed) / each), F.lit(0)))) for fixed, each, most in ACTIONS.values()]
    told = told.withColumn("chunk", F.least(*chunks).cast("long"))
    safe = F.floor(F.col("most") / 10_000) * (10_000 - MARGIN)
    blockers = F.array(
        F.when(F.col("tier").isNull(), "TIER_UNKNOWN"), F.when(F.col("current") >= F.col("most"), "CURRENT_DATABASE_OVER_LIMIT"), F.when(F.col("projected") > safe, "PROJECTED_DATABASE_EXCEEDS_SAFE_LIMIT"),
        F.when(F.col("export_age").isNull(), "BACKUP_PROOF_MISSING").when(F.col("export_age") > 24, "BACKUP_EXPORT_STALE"), F.when(F.col("export_age").isNotNull() & (F.col("travel_age") > 24), "TIME_TRAVEL_PROOF_STALE"), F.when(F.col("chunk") == 0, "QUERY_BUDGET_EXHAUSTED"),
    )
    return told.select("source", "projected", "chunk", F.array_join(F.array_sort(F.array_compact(blockers)), ",").alias("blockers"))


@query("""
SELECT c_custkey, s.s_suppkey AS legacy FROM customer LEFT JOIN supplier s ON c_acctbal > 0 AND s.s_name = 'Supplier#' || lpad((c_custkey % 200)::VARCHAR, 9, '0') AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = c_nationkey % 5)""")
def legacy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join on a key that is put together, of which the match must have an owner that fits the asking row."""
    # the correlated EXISTS is a join with the owner before, whose key is then one of the join's
    owned = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_regionkey")
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0"))
    on = (F.col("c_acctbal") > 0) & (F.col("s_name") == name) & (F.col("n_regionkey") == F.col("c_nationkey") % 5)
    return table(spark, sf_dir, "customer").join(owned, on, "left").select("c_custkey", F.col("s_suppkey").alias("legacy"))


@query("""
WITH j AS (SELECT o_orderpriority AS kind, l_shipmode_ AS version, l_shipdate AS done FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R'))
SELECT kind, NULL AS version, strftime(max(done), '%Y-%m-%d') AS last_success FROM j GROUP BY kind UNION ALL SELECT kind, version, strftime(max(done), '%Y-%m-%d') FROM j GROUP BY kind, version""")
def success_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last success of each kind of work and of each of its versions, from events joined with their work (A4)."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").select("l_orderkey", F.col("l_linestatus").alias("version"), "l_shipdate")
    # the events of an order are combined before the join
    last = done.groupBy("l_orderkey", "version").agg(F.max("l_shipdate").alias("at"))
    joined = last.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind")), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupingSets([["kind"], ["kind", "version"]], "kind", "version").agg(F.date_format(F.max("at"), "yyyy-MM-dd").alias("last_success"))


@query("""
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 15 AS attempt, ('0x' || substr(sha256('delay:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS sample FROM events WHERE event_type = 'error')
SELECT event_id, attempt, least(1800000, 30000 * 2 ** least(greatest(attempt - 1, 0), 6))::BIGINT AS plain, greatest(1, floor(least(3600000, 5000 * 2 ** least(greatest(attempt - 1, 0), 10)) * (0.5::DOUBLE + sample * 0.5::DOUBLE)))::BIGINT AS jittered FROM e""")
def jittered_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential delays up to a cap, and ones between a half and the whole of it, drawn by a hash of the event so that a replay waits as long."""
    attempt = (F.get_json_object("props", "$.k").cast("long") % 15).alias("attempt")
    sample = F.conv(F.substring(F.sha2(F.concat(F.lit("delay:"), F.col("event_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", attempt, sample.alias("sample"))
    ceiling = lambda base, cap, steps: F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.least(F.greatest(F.col("attempt") - 1, F.lit(0)), F.lit(steps))))
    jittered = F.greatest(F.lit(1), F.floor(ceiling(5000, 3_600_000, 10) * (0.5 + F.col("sample") * 0.5)))
    return rows.select("event_id", "attempt", ceiling(30_000, 1_800_000, 6).cast("long").alias("plain"), jittered.cast("long").alias("jittered"))


@query("""
WITH a AS (SELECT doc_id, source, lang, length(text) AS n, sha256(text) AS hash, sha256(lower(trim(text))) AS print FROM documents),
b AS (SELECT print, min(doc_id) AS lead, count(DISTINCT hash) AS spellings FROM a GROUP BY print),
r AS (SELECT a.*, lead, spellings, l.quality, l.n_labels FROM a JOIN b ON b.print = a.print LEFT JOIN (SELECT doc_id, max(quality) AS quality, count(*) AS n_labels FROM labels GROUP BY doc_id) l ON l.doc_id = a.doc_id),
o AS (SELECT doc_id, CASE WHEN n = 0 THEN 'quarantined' WHEN quality = 1 THEN 'bound' WHEN lead <> doc_id AND spellings = 1 THEN 'bound' WHEN lead <> doc_id THEN 'quarantined' WHEN quality = 0 THEN 'quarantined' ELSE 'pending' END AS route,
  CASE WHEN n = 0 THEN 'SOURCE_EMPTY' WHEN quality = 1 THEN 'canonical' WHEN lead <> doc_id AND spellings = 1 THEN 'fingerprint' WHEN lead <> doc_id THEN 'FINGERPRINT_AMBIGUOUS' WHEN quality = 0 THEN 'SOURCE_REJECTED' ELSE 'awaits_resolution' END AS code, source FROM r)
SELECT source, route, code, count(*) AS items, min(doc_id) AS first_id FROM o GROUP BY ALL""")
def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources bound by their own record, else by a fingerprint that only one spelling has, else pending, or quarantined with a code."""
    a = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"), F.sha2("text", 256).alias("hash"), F.sha2(F.lower(F.trim("text")), 256).alias("print"))
    b = a.groupBy("print").agg(F.min("doc_id").alias("lead"), (F.min("hash") == F.max("hash")).alias("one"))
    l = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))  # noqa: E741
    rows = a.join(b, "print").join(l, F.col("doc_id") == F.col("labelled"), "left")
    copy = F.col("lead") != F.col("doc_id")
    gates = [(F.col("n") == 0, "quarantined", "SOURCE_EMPTY"), (F.col("quality") == 1, "bound", "canonical"), (copy & F.col("one"), "bound", "fingerprint"), (copy, "quarantined", "FINGERPRINT_AMBIGUOUS"), (F.col("quality") == 0, "quarantined", "SOURCE_REJECTED"), (F.lit(True), "pending", "awaits_resolution")]
    decided = F.coalesce(*[F.when(when, F.struct(F.lit(route).alias("route"), F.lit(code).alias("code"))) for when, route, code in gates])
    return rows.select("source", "doc_id", decided.alias("d")).groupBy("source", "d.route", "d.code").agg(F.count("*").alias("items"), F.min("doc_id").alias("first_id"))


@query(rf"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN split_part(text, chr(10), 1) END AS title, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text, CASE doc_id % 17 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE source END AS author FROM documents)
SELECT doc_id, CASE WHEN NOT {filled_sql("text")} THEN CASE WHEN title IS NULL THEN 'missing_title_and_content' ELSE 'missing_content' END WHEN title IS NULL THEN 'missing_title' WHEN author IS NULL OR NOT {filled_sql("author")} THEN 'missing_author'
  WHEN regexp_matches(text, '{UNSAFE_SQL}') OR regexp_matches(title, '{UNSAFE_SQL}') THEN 'unsafe_source_text' WHEN length(title) NOT BETWEEN 1 AND 500 OR len(string_split(text, chr(10))) > 2000 OR length(text) > 20000 THEN 'source_text_constraints' END AS reason FROM t""")
def ineligible_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason, in a fixed order, for which a text can't be worked on; null if there is none."""
    doc = F.col("doc_id")
    title = F.when(doc % 11 != 0, F.split_part("text", F.lit("\n"), F.lit(1))).alias("title")
    author = F.when(doc % 17 == 1, "  ").when(doc % 17 != 0, F.col("source")).alias("author")
    t = table(spark, sf_dir, "documents").select("doc_id", title, author, F.when(doc % 13 == 0, "").otherwise(F.col("text")).alias("text"))
    text, own = F.col("text"), F.col("title")
    unsafe = text.rlike(P.UNSAFE) | own.rlike(P.UNSAFE)
    bounds = ~F.length(own).between(1, 500) | (F.size(F.split(text, "\n")) > 2000) | (F.length(text) > 20_000)
    none = F.when(own.isNull(), "missing_title_and_content").otherwise("missing_content")
    reason = F.when(~filled(text), none).when(own.isNull(), "missing_title").when(~filled(F.col("author")), "missing_author").when(unsafe, "unsafe_source_text").when(bounds, "source_text_constraints")
    return t.select("doc_id", reason.alias("reason"))


#: Labels of waits that come before any estimate, in order of precedence.
WAITS = [("paused", "ETA paused"), ("budget", "ETA waiting for budget"), ("auth", "ETA waiting for sign-in"), ("quota", "ETA waiting on quota"), ("network", "ETA waiting for internet"), ("retry", "ETA waiting to retry")]
WAIT_SQL = {"paused": "user_id % 29 = 0", "budget": "user_id % 31 = 1", "auth": "user_id % 37 = 2", "quota": "errors * 4 > n", "network": "user_id % 41 = 3", "retry": "errors * 5 > n"}


@query(f"""
WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'view') AS due FROM events GROUP BY user_id)
SELECT user_id, CASE {" ".join(f"WHEN {WAIT_SQL[k]} THEN '{label}'" for k, label in WAITS)} WHEN due = 0 THEN 'complete' WHEN done = 0 THEN 'ETA learning' WHEN due < done THEN 'under an hour' WHEN due < 48 * done THEN (due // done) || ' h' ELSE (due // done // 24) || ' d' END AS eta FROM u""")
def wait_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of the time left: a wait, the most important first, else complete, else learning, else an estimate."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), kind("error").alias("errors"), kind("purchase").alias("done"), kind("view").alias("due"))
    estimate = F.when(F.expr("due = 0"), "complete").when(F.expr("done = 0"), "ETA learning").when(F.expr("due < done"), "under an hour").when(F.expr("due < 48 * done"), F.expr("concat(due div done, ' h')")).otherwise(F.expr("concat(due div done div 24, ' d')"))
    return u.select("user_id", F.coalesce(*[F.when(F.expr(WAIT_SQL[k]), label) for k, label in WAITS], estimate).alias("eta"))


@query(f"""
WITH s AS (SELECT page_id % 4 AS shard, url FROM pages WHERE page_id % 4 <> 3 OR page_id < 40 UNION ALL SELECT 4, url || '&n=' || i FROM pages CROSS JOIN range({CAP}) t(i) WHERE page_id = 0 UNION ALL SELECT 5, url || '&n=' || i FROM pages CROSS JOIN range({CAP + 1}) t(i) WHERE page_id = 0),
e AS (SELECT shard, count(*) AS urls, sha256('{HEAD}' || string_agg('<url><loc>' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</loc></url>', '' ORDER BY url) || '{FOOT}') AS document FROM s GROUP BY shard)
SELECT shard::INTEGER AS shard, urls, urls <= {CAP} AS written, CASE WHEN urls <= {CAP} THEN document END AS document FROM e""")
def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site maps written as files, one a shard; a shard of just the cap is written, one of a URL more is not."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = pages.where("page_id % 4 <> 3 OR page_id < 40").select((F.col("page_id") % 4).cast("int").alias("shard"), "url")
    for shard, n in ((4, CAP), (5, CAP + 1)):
        own = own.union(pages.where("page_id = 0").select(F.lit(shard), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "url").select(F.lit(shard), F.concat("url", F.lit("&n="), "i")))
    folder = f"{shared_folder(spark)}/sitemaps"
    verdicts = write_sitemaps(own, folder)
    return verdicts.join(read_sitemaps(spark, folder).select("shard", F.sha2("value", 256).alias("document")), "shard", "left")
