"""Exchange by files in the shared folder: line JSON, snapshots with replay, sorted extracts, content-addressed texts, bounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.plans.registry import query
from lexiforge.sources import tables as S
from lexiforge.sources.feeds import merged, read_feeds, write_feed
from lexiforge.sources.logs import append_log, committed, read_log
from lexiforge.sources.pairs import export_tables, read_table
from lexiforge.sources.tables import table
from lexiforge.streaming.events import shared_folder


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def ndjson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as line JSON in the order of their key and read again by a strict reader."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    path = f"{shared_folder(spark)}/customer"
    S.write_ndjson(rows, path, "c_custkey")
    return S.read_ndjson(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))


@query("""
WITH h AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders),
b AS (SELECT substr(h, 1, 2) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1),
d AS (SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY b)) AS sha256 FROM b)
SELECT 1 AS pass, rows, sha256, false AS replayed FROM d UNION ALL SELECT 2, rows, sha256, true FROM d""")
def snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export that is put in place at once, and found there when it is made again from rows in another order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    folder = f"{shared_folder(spark)}/orders"
    first = S.export_snapshot(rows, folder, "o_orderkey")
    second = S.export_snapshot(rows.repartition(7, "o_custkey"), folder, "o_orderkey")
    return first.select(F.lit(1).alias("pass"), "*").union(second.select(F.lit(2), "*"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, 'order' AS by FROM orders WHERE o_orderkey = 33 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'customer' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)")
def extract_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted extract, asked for one key and for a table of another."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = f"{shared_folder(spark)}/extract"
    S.write_extract(rows, path, "o_orderkey")
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("o_custkey"))
    one, many = S.lookup(spark, path, "o_orderkey", 33), S.lookup_all(spark, path, wanted).select(rows.columns)
    return one.withColumn("by", F.lit("order")).union(many.withColumn("by", F.lit("customer")))


@query("""
SELECT substr(sha256(text), 1, 2) AS fan, count(DISTINCT text) AS stored, 0 AS broken FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) GROUP BY fan
UNION ALL SELECT 'ff', 1, 1""".replace("SELECT substr", "SELECT fan, CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(broken) AS BIGINT) AS broken FROM (SELECT substr", 1) + ") GROUP BY fan")
def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under their digests, put twice; the inventory finds one that was changed."""
    folder = f"{shared_folder(spark)}/artifacts"
    texts = table(spark, sf_dir, "documents").select("text")
    S.put_artifacts(texts, folder)
    S.put_artifacts(texts.union(table(spark, sf_dir, "benchmark").select("text")), folder)
    spark.createDataFrame([("ff" * 32, "changed", "ff")], "sha256 string, value string, fan string").write.mode("append").partitionBy("fan").parquet(folder)
    stored = S.stored_artifacts(spark, folder).groupBy("fan").agg(F.count("*").alias("stored"))
    broken = S.verify_artifacts(spark, folder).groupBy("fan").agg(F.count("*").alias("broken"))
    return stored.join(broken, "fan", "left").select("fan", "stored", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


@query("""
WITH s AS (SELECT user_id, event_id, length('{"at":' || event_id || ',"kind":"' || event_type || '"}') AS bytes FROM events),
r AS (SELECT *, sum(bytes + 1) OVER (PARTITION BY user_id ORDER BY event_id DESC) + 1 AS total FROM s)
SELECT user_id, count(*) AS kept, min(event_id) AS oldest, CAST(max(total) AS BIGINT) AS bytes FROM r WHERE total <= 1024 GROUP BY user_id""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest samples of each key whose JSON array fits a bound of bytes."""
    sample = F.to_json(F.struct(F.col("event_id").alias("at"), F.col("event_type").alias("kind")))
    sized = table(spark, sf_dir, "events").select("user_id", "event_id", F.octet_length(sample).alias("bytes"))
    # brackets and the commas between samples count
    total = F.sum(F.col("bytes") + 1).over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))) + 1
    return sized.withColumn("total", total).where("total <= 1024").groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("oldest"), F.max("total").alias("bytes"))


PAIR = {"customers": "c_custkey long, c_name string, c_nationkey int", "orders": "o_orderkey long, o_custkey long, o_orderstatus string"}


@query("""
WITH h AS (
  SELECT 'customers' AS name, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS h FROM customer
  UNION ALL SELECT 'orders', sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') FROM orders),
b AS (SELECT name, substr(h, 1, 2) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1, 2),
d AS (SELECT name, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY b)) AS sha256 FROM b GROUP BY name)
SELECT pass, name, rows, sha256, pass = 2 AS replayed, CASE name WHEN 'customers' THEN (SELECT sum(c_custkey) FROM customer) ELSE (SELECT sum(o_orderkey) FROM orders) END::BIGINT AS keys FROM d, (VALUES (1), (2)) p(pass)""")
def snapshot_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables exported as one, found again when they are exported from rows in another order, and read through the manifest."""
    rows = {"customers": table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")}
    keys, folder = {"customers": "c_custkey", "orders": "o_orderkey"}, f"{shared_folder(spark)}/pair"
    first = export_tables({n: (r, keys[n]) for n, r in rows.items()}, folder)
    second = export_tables({n: (r.repartition(5, r.columns[1]), keys[n]) for n, r in rows.items()}, folder)
    both = first.select(F.lit(1).alias("pass"), "*").union(second.select(F.lit(2), "*"))
    sums = None
    for name in rows:
        own = read_table(spark, folder, name, PAIR[name]).agg(F.sum(keys[name]).alias("keys")).select(F.lit(name).alias("name"), "keys")
        sums = own if sums is None else sums.union(own)
    return both.join(sums, "name")


#: Items of a page of a feed.
PAGE = 20


@query(f"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*\\.(example\\.[a-z]+)', 1) AS feed, regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS href, CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 5 AS VARCHAR) ELSE 'page of ' || regexp_extract(url, '://([^/?#]*)', 1) END AS title FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY page_id) - 1 AS r FROM p WHERE feed <> ''),
k AS (SELECT *, r // {PAGE} AS page FROM n WHERE NOT (feed = 'example.net' AND r // {PAGE} >= 2)),
t AS (SELECT *, row_number() OVER (PARTITION BY feed, href ORDER BY regexp_matches(title, '^[0-9]+$'), r) AS place FROM k)
SELECT feed, href, max(title) FILTER (WHERE place = 1) AS title, count(*) - 1 AS repeats, coalesce(min(title) FILTER (WHERE NOT regexp_matches(title, '^[0-9]+$')) <> max(title) FILTER (WHERE NOT regexp_matches(title, '^[0-9]+$')), false) AS conflict, max(page)::INTEGER AS last_page
FROM t GROUP BY feed, href""")
def paged_feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds read page by page along their cursors and merged by target; one stops at a cursor that is known, one turns back on itself."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    items = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*\.(example\.[a-z]+)", 1).alias("feed"), F.regexp_extract("url", r"://[^/?#]*(/[^?#]*)", 1).alias("href"), F.when(F.col("page_id") % 3 == 0, (F.col("page_id") % 5).cast("string")).otherwise(F.concat(F.lit("page of "), host)).alias("title")).where("feed <> ''")
    numbered = items.withColumn("r", F.row_number().over(Window.partitionBy("feed").orderBy("page_id")) - 1).withColumn("page", F.floor(F.col("r") / PAGE))
    last = F.max("page").over(Window.partitionBy("feed"))
    cursor = lambda page: F.when(page == 0, "first").otherwise(F.concat(F.lit("c"), page))
    after = F.when(F.col("page") < last, cursor(F.col("page") + 1)).when(F.col("feed") == "example.com", "first")
    path = f"{shared_folder(spark)}/feeds"
    write_feed(numbered.select("feed", cursor(F.col("page")).alias("cursor"), after.alias("next"), (F.col("r") % PAGE).alias("position"), "href", "title"), path)
    names = sorted(r.feed for r in numbered.select("feed").distinct().collect())  # the sources' names
    read = read_feeds(spark, path, names, known={"example.net": "c2"})
    return merged(read).join(read.groupBy("feed", "href").agg(F.max("page").alias("last_page")), ["feed", "href"])


@query("""
SELECT pass, count(*) AS lines, sum(event_id)::BIGINT AS ids, count(DISTINCT user_id) AS users, true AS bounded, true AS rolled FROM events, (VALUES (1), (2)) p(pass) WHERE pass = 1 OR event_type <> 'view' GROUP BY pass""")
def rotated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of events as files of bounded size, each batch committed once though it is written twice."""
    rows, bound, out = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), 20_000, None
    for number, part in ((1, rows), (2, rows.where("event_type <> 'view'"))):
        path = f"{shared_folder(spark)}/log"
        for batch, own in (("a", part.where("event_id % 2 = 0")), ("b", part.where("event_id % 2 = 1")), ("a", part.where("event_id % 2 = 0"))):
            append_log(own, path, batch, bound)
        files = committed(spark, path).agg((F.max("bytes") <= bound).alias("bounded"), (F.count("*") >= F.floor(F.sum("bytes") / bound)).alias("rolled"))
        read = read_log(spark, path, rows.schema).agg(F.count("*").alias("lines"), F.sum("event_id").alias("ids"), F.count_distinct("user_id").alias("users"))
        one = read.crossJoin(files).select(F.lit(number).alias("pass"), "*")  # one row each
        out = one if out is None else out.union(one)
    return out
