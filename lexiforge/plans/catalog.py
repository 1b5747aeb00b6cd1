"""The catalogue: publishable rows, pages, stars, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import predicates as P
from lexiforge.functions import text as X
from lexiforge.plans.registry import query
from lexiforge.sources.tables import table

SAFE_SQL = "length({0}) BETWEEN 1 AND 500 AND trim({0}) = {0} AND {0} NOT IN ('.', '..') AND NOT contains({0}, '/')"


@query(f"""
SELECT c_custkey AS author_id, c_name AS name, lower(c_name) AS sort_name, nullif(trim(c_mktsegment), '') AS segment, count(*) AS poems
FROM customer JOIN orders ON o_custkey = c_custkey WHERE {SAFE_SQL.format("c_name")} GROUP BY ALL""")
def catalog_author_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names with their number of works, by folded name and id."""
    authors = table(spark, sf_dir, "customer").where(P.safe_identity(F.col("c_name")))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("poems"))
    named = authors.join(counts, "c_custkey").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), F.lower(X.sort_fold(F.col("c_name"))).alias("sort_name"), P.blank_to_null(F.col("c_mktsegment")).alias("segment"), "poems")
    return named.orderBy("sort_name", "author_id")


@query("""
WITH p AS (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate, o_orderkey LIMIT 5 OFFSET 5)
SELECT o_orderkey, o_totalprice, total, CAST(ceil(total / 5.0) AS BIGINT) AS pages FROM p""")
def catalog_author_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five of one author's works, with totals (T4)."""
    works = table(spark, sf_dir, "orders").where(F.col("o_custkey") == 7)
    totals = works.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / 5))
    page = works.orderBy("o_orderdate", "o_orderkey").offset(5).limit(5).select("o_orderkey", "o_totalprice")
    return page.crossJoin(F.broadcast(totals))  # one row


@query("""
SELECT r_name, n_name, p_type, count(*) AS items, CAST(sum(l_quantity) AS BIGINT) AS quantity, CASE WHEN count(*) > 20 THEN max(s_name) END AS top_supplier
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def catalog_detail_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of seven tables, with a guarded scalar."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows in every size
    buyers = t("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    star = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = star.groupBy("r_name", "n_name", "p_type").agg(F.count("*").alias("items"), F.sum("l_quantity").cast("long").alias("quantity"), F.max("s_name").alias("top"))
    return sums.withColumn("top_supplier", F.when(F.col("items") > 20, F.col("top"))).drop("top")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N' AND l_quantity >= 10)""")
def catalog_validated_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that have every required validation: relational division by one aggregation."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") | (F.col("l_returnflag") == "N") & (F.col("l_quantity") >= 10))
    passed = items.groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("kinds")).where("kinds = 3")
    return table(spark, sf_dir, "orders").join(passed, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


SHARD_SQL = "CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 2147483647) % 16 AS INT)"


@query(f"""
WITH s AS (SELECT doc_id, {SHARD_SQL.format("CAST(doc_id AS VARCHAR)")} AS shard FROM documents)
SELECT shard, count(*) AS urls, min(doc_id) AS first_id, count(*) > 50000 AS truncated FROM s GROUP BY shard""")
def sitemap_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the shard of their id, and whether a shard is too large for one map."""
    sharded = table(spark, sf_dir, "documents").select("doc_id", X.shard(F.col("doc_id").cast("string")).alias("shard"))
    return sharded.groupBy("shard").agg(F.count("*").alias("urls"), F.min("doc_id").alias("first_id"), (F.count("*") > 50000).alias("truncated"))


@query("""
SELECT page_id, '<url><loc>' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</loc></url>' AS entry FROM pages""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped entries of a site map."""
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<url><loc>"), X.escaped(F.col("url")), F.lit("</loc></url>")).alias("entry"))


@query(r"""
SELECT doc_id, lang = 'en' AS has_english, lang <> 'en' AND n_chars BETWEEN 1 AND 2000 AS short_foreign,
  CASE WHEN n_chars BETWEEN 1 AND 5000 AND trim(text) = text AND NOT contains(text, '|') AND NOT regexp_matches(text, '(?i)(i cannot|as an ai)') THEN 1 ELSE 0 END AS publishable FROM documents""")
def publishable_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags derived when a row is written."""
    text = F.col("text")
    ok = P.all_of(F.col("n_chars").between(1, 5000), F.trim(text) == text, ~text.contains("|"), ~text.rlike("(?i)(i cannot|as an ai)"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("has_english"), ((F.col("lang") != "en") & F.col("n_chars").between(1, 2000)).alias("short_foreign"), F.when(ok, 1).otherwise(0).alias("publishable"))


@query("""
SELECT event_type, count(*) AS events, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 2147483647 END AS position FROM events GROUP BY event_type""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known kinds first, unknown last."""
    place = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3).otherwise(2147483647)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events")).withColumn("position", place).orderBy("position", "event_type")


@query(r"""
SELECT doc_id, coalesce(CASE WHEN trim(a) <> '' AND length(a) <= 40 THEN trim(a) END, CASE WHEN trim(b) <> '' AND length(b) <= 40 THEN trim(b) END) AS title
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS a, split_part(text, chr(10), 2) AS b FROM documents)""")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable of two lines as the title."""
    part = lambda k: F.split_part("text", F.lit("\n"), F.lit(k))
    usable = lambda t: F.when(F.length(t) <= 40, t)
    return table(spark, sf_dir, "documents").select("doc_id", P.first_usable(usable(part(1)), usable(part(2))).alias("title"))


@query("""
SELECT CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'blue') THEN 'blue' ELSE 'other' END AS family,
  regexp_extract(p_brand, '^Brand#([1-9][0-9]*)$', 1) AS brand_number, count(*) AS parts FROM part GROUP BY ALL""")
def label_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family by label with a fallback, and the number in a name template."""
    name = F.col("p_name")
    family = F.when(name.contains("red"), "red").when(name.contains("blue"), "blue").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(family.alias("family"), F.regexp_extract("p_brand", r"^Brand#([1-9][0-9]*)\z", 1).alias("brand_number")).agg(F.count("*").alias("parts"))


@query("""
SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, lag(role) OVER w AS previous_role
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in order, with a unique key as the tie-break."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("next"), F.lag("role").over(w).alias("previous_role"))
