"""Resolving identities and lineage: semi, anti, left, star and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.plans.registry import query
from lexiforge.sources.tables import table


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)")
def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a match."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)")
def semi_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with a match."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))""")
def nested_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a member that is an orphan."""
    orphans = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return table(spark, sf_dir, "customer").join(orphans, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""
SELECT p_partkey FROM part WHERE p_size < 10 AND NOT EXISTS (
  SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'F' AND l_quantity > 30)""")
def uncovered_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand that no joined pair covers."""
    covered = table(spark, sf_dir, "lineitem").where("l_quantity > 30").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return table(spark, sf_dir, "part").where("p_size < 10").join(covered, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""
SELECT o_orderkey, min(c_custkey) AS resolved, count(*) AS matches FROM orders JOIN customer ON o_custkey = c_custkey OR o_orderkey = c_custkey GROUP BY o_orderkey""")
def disjunctive_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By one key or another: two hash joins and a union in place of a nested loop."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    by = lambda key: o.join(c, F.col(key) == F.col("c_custkey")).select("o_orderkey", "c_custkey")
    pairs = by("o_custkey").union(by("o_orderkey")).distinct()
    return pairs.groupBy("o_orderkey").agg(F.min("c_custkey").alias("resolved"), F.count("*").alias("matches"))


REQUESTED = [905, 3, 1204, 77, 3, 999999]


@query("""
WITH r AS (SELECT * FROM (VALUES (0, 905), (1, 3), (2, 1204), (3, 77), (5, 999999)) AS t(pos, id))
SELECT CAST(pos AS INT) AS pos, CAST(id AS BIGINT) AS id, c_name FROM r LEFT JOIN customer ON c_custkey = id""")
def batch_lookup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal batch in the order of first request."""
    batch = spark.createDataFrame([(str(REQUESTED),)], "json string").select(F.posexplode(F.from_json("json", "array<bigint>")).alias("pos", "id"))
    first = batch.groupBy("id").agg(F.min("pos").alias("pos"))
    return first.join(table(spark, sf_dir, "customer"), F.col("id") == F.col("c_custkey"), "left").orderBy("pos").select("pos", "id", "c_name")


@query("""
WITH t AS (SELECT count(*) AS total, max(o_totalprice) AS top FROM orders), p AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 1e9 ORDER BY o_orderkey LIMIT 5)
SELECT total, top, o_orderkey FROM t LEFT JOIN p ON true""")
def totals_with_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that stay when the page is empty."""
    orders = table(spark, sf_dir, "orders")
    totals = orders.agg(F.count("*").alias("total"), F.max("o_totalprice").alias("top"))
    page = orders.where("o_totalprice > 1e9").orderBy("o_orderkey").limit(5).select("o_orderkey")
    return totals.join(F.broadcast(page), F.lit(True), "left").select("total", "top", "o_orderkey")


@query("""
SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN c_custkey IS NULL THEN 'new' ELSE 'missing' END AS side
FROM (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 100000) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL""")
def setdiff_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either has alone of customers in credit and customers with a small order, by one full join."""
    known = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey")
    found = table(spark, sf_dir, "orders").where("o_totalprice < 100000").select("o_custkey").distinct()
    both = known.join(found, F.col("c_custkey") == F.col("o_custkey"), "full").where("c_custkey is null or o_custkey is null")
    return both.select(F.coalesce("c_custkey", "o_custkey").alias("id"), F.when(F.col("c_custkey").isNull(), "new").otherwise("missing").alias("side"))


@query("""
SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus
WHERE a.l_linenumber < b.l_linenumber GROUP BY ALL""")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A self join on three keys."""
    items = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_returnflag", "l_linestatus"]
    pairs = items.select(*keys, "l_partkey", "l_suppkey", "l_linenumber").join(items.select(*keys, F.col("l_linenumber").alias("other")), keys).where("l_linenumber < other")
    return pairs.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count("*").alias("pairs"))


@query("""
SELECT c_custkey, coalesce(n_name, 'NONE-' || c_nationkey) AS place FROM customer LEFT JOIN nation ON n_name = 'NATION_' || c_nationkey AND n_regionkey < 3""")
def slug_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join on a key that is put together."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_name")
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.concat(F.lit("NATION_"), F.col("c_nationkey")) == F.col("n_name"), "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("NONE-"), F.col("c_nationkey"))).alias("place"))


@query("SELECT s_suppkey, (SELECT max(r_regionkey) FROM region) AS epoch FROM supplier")
def singleton_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row table attached to all rows."""
    epoch = table(spark, sf_dir, "region").agg(F.max("r_regionkey").alias("epoch"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(epoch))


@query("""
WITH m AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT c_custkey, coalesce(o_orderpriority, 'none') AS attempt FROM customer LEFT JOIN m ON m.o_custkey = c_custkey LEFT JOIN orders ON o_orderkey = k""")
def latest_matching_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest matching row of each key, without a second join."""
    latest = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("p", F.lit("none")).alias("attempt"))


@query("""
WITH r AS (SELECT event_id, unnest(['Brand#' || (k % 25 + 1), 'Brand#' || (k % 7 + 1)]) AS brand FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'signup'))
SELECT event_id, brand, n FROM (SELECT DISTINCT * FROM r) JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) ON p_brand = brand""")
def lateral_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys unnested from each row, then joined."""
    k = F.get_json_object("props", "$.k").cast("long")
    wanted = table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", F.explode(F.array_distinct(F.array(F.concat(F.lit("Brand#"), k % 25 + 1), F.concat(F.lit("Brand#"), k % 7 + 1)))).alias("brand"))
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return wanted.join(counts, "brand").select("event_id", "brand", "n")


@query("""
WITH j AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders JOIN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT o_custkey, o_orderkey AS failure FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM j) WHERE r = 1""")
def newest_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest failure of requests with one member."""
    single = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n = 1")
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(single, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return failed.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("failure"))


@query("""
WITH u AS (SELECT l_orderkey, l_linenumber, CASE WHEN count(*) = 1 THEN max(l_partkey) END AS p FROM lineitem GROUP BY ALL)
SELECT o_orderkey, l_linenumber AS line, p AS outcome FROM orders LEFT JOIN u ON l_orderkey = o_orderkey""")
def unique_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome whose id stands twice counts as missing, as null."""
    outcomes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.when(F.count("*") == 1, F.max("l_partkey")).alias("p"))
    return table(spark, sf_dir, "orders").join(outcomes, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_linenumber").alias("line"), F.col("p").alias("outcome"))


@query("""
WITH c AS (SELECT c_custkey % 100 AS ordinal, c_custkey AS revision FROM customer),
r AS (SELECT *, count(*) OVER (PARTITION BY ordinal) AS candidates, row_number() OVER (PARTITION BY ordinal ORDER BY revision) AS k FROM c)
SELECT ordinal, revision, candidates, candidates > 1 AS ambiguous FROM r WHERE k = 1""")
def ambiguity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate and how many there are."""
    w = Window.partitionBy("ordinal")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("ordinal"), F.col("c_custkey").alias("revision"))
    ranked = c.withColumns({"candidates": F.count("*").over(w), "k": F.row_number().over(w.orderBy("revision"))})
    return ranked.where("k = 1").select("ordinal", "revision", "candidates", (F.col("candidates") > 1).alias("ambiguous"))


@query("""
WITH a AS (SELECT doc_id, split_part(text, ' ', 1) AS word, sha256(lower(trim(text))) AS f FROM documents), b AS (SELECT min(doc_id) AS lead, f FROM a GROUP BY f)
SELECT CASE WHEN p.item_id IS NOT NULL THEN 'canonical' WHEN b.lead <> a.doc_id THEN 'fingerprint' WHEN l.doc_id IS NOT NULL THEN 'pending' ELSE 'terminal' END AS outcome, count(*) AS items
FROM a JOIN b ON a.f = b.f LEFT JOIN (SELECT min(item_id) AS item_id, split_part(text, ' ', 1) AS word FROM benchmark GROUP BY word) p ON p.word = a.word LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = a.doc_id GROUP BY outcome""")
def cascading_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical (here: by the first word of a known item), then fingerprint, then pending, else terminal; counts of each outcome."""
    word = F.split_part("text", F.lit(" "), F.lit(1)).alias("word")
    a = table(spark, sf_dir, "documents").select("doc_id", word, F.sha2(F.lower(F.trim("text")), 256).alias("f"))
    known = table(spark, sf_dir, "benchmark").groupBy(word).agg(F.min("item_id").alias("item_id"))
    b = a.groupBy("f").agg(F.min("doc_id").alias("lead"))
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled")).distinct()
    joined = a.join(b, "f").join(known, "word", "left").join(seen, F.col("doc_id") == F.col("labelled"), "left")
    outcome = F.when(F.col("item_id").isNotNull(), "canonical").when(F.col("lead") != F.col("doc_id"), "fingerprint").when(F.col("labelled").isNotNull(), "pending").otherwise("terminal")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("items"))


@query("""
SELECT o_custkey, o_orderkey, count(DISTINCT l_suppkey) AS suppliers FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_quantity > 45 GROUP BY ALL""")
def inner_with_conjuncts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equi-join with further conditions."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45"), (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")))
    return joined.groupBy("o_custkey", "o_orderkey").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("""
SELECT c_mktsegment, coalesce(o_orderpriority, 'none') AS priority, count(*) AS items, count(o_orderkey) AS matched
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON o_custkey = c_custkey GROUP BY ALL""")
def manifest_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small side that is built, a large one that probes."""
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_custkey", "o_orderkey", "o_orderpriority")
    joined = table(spark, sf_dir, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_mktsegment", F.coalesce("o_orderpriority", F.lit("none")).alias("priority")).agg(F.count("*").alias("items"), F.count("o_orderkey").alias("matched"))
