"""Reconciling staged rows with current state: plans, repairs, audits, certificates."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.plans.registry import query
from lexiforge.sources.tables import table

#: Digests that a range is sized for, and that a block of a range holds at most.
RANGE_ROWS, BLOCK_ROWS = 250_000, 16_384


@query("""
WITH s AS (SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS staged FROM lineitem GROUP BY l_orderkey), p AS (SELECT o_orderkey, o_orderkey % 8 AS version FROM orders WHERE o_orderstatus <> 'O')
SELECT CASE WHEN o_orderkey IS NULL THEN 'insert' ELSE 'reuse' END AS revision, CASE WHEN o_orderkey IS NULL THEN 'create' WHEN staged > version THEN 'advance' ELSE 'unchanged' END AS pointer, count(*) AS items
FROM s LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY ALL""")
def promotion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each staged row would do."""
    staged = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("staged"))
    state = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select("o_orderkey", (F.col("o_orderkey") % 8).alias("version"))
    joined = staged.join(state, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    missing = F.col("o_orderkey").isNull()
    pointer = F.when(missing, "create").when(F.col("staged") > F.col("version"), "advance").otherwise("unchanged")
    return joined.groupBy(F.when(missing, "insert").otherwise("reuse").alias("revision"), pointer.alias("pointer")).agg(F.count("*").alias("items"))


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'author_missing' WHEN l_orderkey IS NULL THEN 'detail_missing' ELSE 'repairable' END AS reason
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey""")
def orphan_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row can't be repaired, if it can't."""
    authors = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    details = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    joined = table(spark, sf_dir, "orders").join(authors, F.col("o_custkey") == F.col("c_custkey"), "left").join(details, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.when(F.col("c_custkey").isNull(), "author_missing").when(F.col("l_orderkey").isNull(), "detail_missing").otherwise("repairable").alias("reason"))


@query("""
SELECT 'orders without customer' AS audit, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'items without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'items without part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'customers without nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'labels without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'items repeated in an order', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def referential_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a reference, by rule."""
    t = lambda name: table(spark, sf_dir, name)
    repeated = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    broken = {
        "orders without customer": t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "items without order": t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "items without part": t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti"),
        "customers without nation": t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti"),
        "labels without document": t("labels").join(t("documents").select("doc_id"), "doc_id", "left_anti"),
        "items repeated in an order": repeated,
    }
    counts = [rows.agg(F.lit(name).alias("audit"), F.count("*").alias("violations")) for name, rows in broken.items()]
    result = counts[0]
    for c in counts[1:]:
        result = result.union(c)
    return result


@query("""
SELECT count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-01-01' AND p.k IS NULL) AS eligible, count(*) FILTER (WHERE o_orderstatus <> 'F') AS active,
  count(*) FILTER (WHERE p.k IS NOT NULL) AS protected, strftime(min(CASE WHEN o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' THEN o_orderdate END), '%Y-%m-%d') AS next_at
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity >= 50) p ON p.k = o_orderkey""")
def retention_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may go: terminal, old and not protected; and when the next may."""
    protected = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("k")).distinct()
    rows = table(spark, sf_dir, "orders").join(protected, F.col("o_orderkey") == F.col("k"), "left")
    done, old = F.col("o_orderstatus") == "F", F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return rows.agg(F.count_if(done & old & F.col("k").isNull()).alias("eligible"), F.count_if(~done).alias("active"), F.count_if(F.col("k").isNotNull()).alias("protected"), F.date_format(F.min(F.when(done & ~old, F.col("o_orderdate"))), "yyyy-MM-dd").alias("next_at"))


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'terminal' WHEN b.n > a.n THEN 'refreshed' ELSE 'active' END AS kind, count(*) AS items FROM a FULL JOIN b ON a.o_custkey = b.o_custkey GROUP BY kind""")
def recovery_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a set changed: new, refreshed, active, terminal, from one grouped pass."""
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    kind = F.when(F.col("a") == 0, "new").when(F.col("b") == 0, "terminal").when(F.col("b") > F.col("a"), "refreshed").otherwise("active")
    return n.groupBy(kind.alias("kind")).agg(F.count("*").alias("items"))


@query("""
WITH s AS (SELECT source, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source)
SELECT source, digest, n FROM s""")
def multiset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each source's texts that doesn't depend on their order."""
    return multiset_digests(table(spark, sf_dir, "documents").select("source", "text"))


def multiset_digests(docs: DataFrame) -> DataFrame:
    """(source, digest, n) of (source, text): the digest of the texts' digests one after the other in their order.

    Equal digests are counted, then dealt out by ranges and sorted there, and packed
    into blocks. One task a source reads its blocks in order and holds one at a time.
    """
    hashed = docs.select("source", F.sha2("text", 256).alias("h"))
    ranges = max(8, -(-docs.count() // RANGE_ROWS))
    record = F.concat(F.unhex("h"), F.unhex(F.lpad(F.hex("c"), 16, "0"))).alias("record")
    once = hashed.where("h is not null").groupBy("source", "h").agg(F.count("*").alias("c"))
    dealt = once.repartitionByRange(ranges, "source", "h").sortWithinPartitions("source", "h").select("source", "h", record)
    schema = pa.schema([("source", pa.string()), ("first", pa.string()), ("block", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, digests, records = (column.to_pylist() for column in batch.columns)
            start, out = 0, []
            for i in range(1, len(sources) + 1):
                if i == len(sources) or sources[i] != sources[start] or i - start == BLOCK_ROWS:
                    out.append((sources[start], digests[start], b"".join(records[start:i])))
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), schema.types)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, source, sha = [], None, None
        for batch in batches:
            for own, block in zip(batch.column(0), batch.column(1)):
                if sha is None or own.as_py() != source:
                    if sha is not None:
                        done.append((source, sha.hexdigest()))
                    source, sha = own.as_py(), hashlib.sha256()
                for digest, copies in struct.iter_unpack(">32sQ", block.as_py()):
                    digest = digest.hex().encode()
                    for at in range(0, copies, BLOCK_ROWS):
                        sha.update(digest * min(BLOCK_ROWS, copies - at))
        if sha is not None:
            done.append((source, sha.hexdigest()))
        yield pa.RecordBatch.from_pylist([{"source": s, "digest": d} for s, d in done], pa.schema([("source", pa.string()), ("digest", pa.string())]))

    blocks = dealt.mapInArrow(packed, "source string, first string, block binary")
    digests = blocks.repartition("source").sortWithinPartitions("source", "first").select("source", "block").mapInArrow(folded, "source string, digest string")
    counts = hashed.groupBy("source").agg(F.count("*").alias("n"))
    return counts.join(digests.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "digest", "n")


@query("""
WITH a AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS first, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role)) AS second, max(turn) + 1 = count(*) AS continuous FROM conversations GROUP BY conv_id)
SELECT conv_id, first AS digest, first = second AND continuous AS certified FROM a""")
def two_pass_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes, read and ordered each on its own, agree, and turns run from 0 without repeats and gaps."""
    line = lambda s: F.concat(s["role"], F.lit(":"), s["text"])

    def digests(name: str, *order: str) -> DataFrame:
        lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order))), line), "\n")
        return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias(f"{name}_id")).agg(F.sha2(lines, 256).alias(name))

    before = F.lag("turn", 1, -1).over(Window.partitionBy("conv_id").orderBy("turn"))
    steps = table(spark, sf_dir, "conversations").select("conv_id", F.coalesce(F.col("turn") - before == 1, F.lit(False)).alias("next"))
    pages = steps.groupBy("conv_id").agg(F.bool_and("next").alias("continuous"))
    # of equal turns each pass has another first
    first, second = digests("first", "turn", "role", "text"), digests("second", "turn", "text", "role")
    both = pages.join(first, F.col("conv_id").eqNullSafe(F.col("first_id"))).join(second, F.col("conv_id").eqNullSafe(F.col("second_id")))
    return both.select("conv_id", F.col("first").alias("digest"), ((F.col("first") == F.col("second")) & F.col("continuous")).alias("certified"))


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS actual, count(DISTINCT l_linenumber) AS distinct_lines, CAST(max(l_linenumber) AS BIGINT) AS declared FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(actual, 0) AS actual, CASE WHEN actual IS NULL THEN 'empty' WHEN distinct_lines < actual THEN 'duplicate' WHEN declared <> actual THEN 'count_mismatch' ELSE 'valid' END AS verdict
FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates and counts that differ from those declared."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("actual"), F.count_distinct("l_linenumber").alias("lines"), F.max("l_linenumber").alias("declared"))
    joined = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    verdict = F.when(F.col("actual").isNull(), "empty").when(F.col("lines") < F.col("actual"), "duplicate").when(F.col("declared") != F.col("actual"), "count_mismatch").otherwise("valid")
    return joined.select("o_orderkey", F.coalesce("actual", F.lit(0)).alias("actual"), verdict.alias("verdict"))


@query("""
WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey) AS k
  FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48))
SELECT p_brand, p_partkey AS reusable FROM r WHERE k = 1""")
def reuse_by_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reusable row of each material."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_partkey")
    rank = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    parts = table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return parts.groupBy("p_brand").agg(F.min(F.struct(rank.alias("r"), F.negate("p_retailprice").alias("p"), "p_partkey"))["p_partkey"].alias("reusable"))


@query("""
SELECT o_orderkey, sha256('v2' || chr(31) || o_orderkey || chr(31) || o_orderpriority) AS new_key, 'retired' AS old_state FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def retire_incompatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an old version and the keys of those that replace them."""
    old = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority not in ('1-URGENT', '2-HIGH')")
    return old.select("o_orderkey", X.identity_hash(F.lit("v2"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("new_key"), F.lit("retired").alias("old_state"))


@query("""
WITH c AS (SELECT doc_id, sha256(text) AS content, lang, source FROM documents), r AS (SELECT *, sha256(content || chr(31) || doc_id) AS record FROM c)
SELECT doc_id, record, sha256(record || chr(31) || source || chr(31) || lang) AS revision, substr(content, 1, 2) AS fan FROM r""")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content, record and revision hashes, and the artifact's folder."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"), "lang", "source")
    r = c.withColumn("record", X.identity_hash(F.col("content"), F.col("doc_id").cast("string")))
    return r.select("doc_id", "record", X.identity_hash(F.col("record"), F.col("source"), F.col("lang")).alias("revision"), F.substring("content", 1, 2).alias("fan"))


@query("""
SELECT doc_id, CASE WHEN n < 2 THEN false ELSE pass AND low = 0 END AS accepted FROM (
  SELECT d.doc_id, count(*) AS n, bool_and(l.quality = 1) AS pass, max(l.toxic) AS low FROM documents d JOIN (SELECT * FROM labels UNION ALL SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 0) l ON l.doc_id = d.doc_id GROUP BY d.doc_id)""")
def review_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly two reviews that both pass (F16)."""
    labels = table(spark, sf_dir, "labels")
    reviews = labels.unionByName(labels.where("doc_id % 2 = 0"))
    judged = reviews.groupBy("doc_id").agg(F.count("*").alias("n"), F.every(F.col("quality") == 1).alias("ok"), F.max("toxic").alias("toxic"))
    known = table(spark, sf_dir, "documents").select("doc_id")
    return judged.join(known, "doc_id", "left_semi").select("doc_id", ((F.col("n") == 2) & F.col("ok") & (F.col("toxic") == 0)).alias("accepted"))


@query("""
WITH t AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS rows FROM documents GROUP BY source)
SELECT source, bytes, rows, CAST(least(1000, greatest(1, 100000 * rows // bytes)) AS BIGINT) AS chunk, bytes * 10000 // 5000000 > 9000 AS blocked FROM t""")
def capacity_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a chunk under a byte budget, and what is full in basis points."""
    t = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count("*").alias("rows"))
    return t.select("source", "bytes", "rows", F.expr("least(1000, greatest(1, 100000 * rows div bytes))").alias("chunk"), F.expr("bytes * 10000 div 5000000 > 9000").alias("blocked"))


@query("""
SELECT page_id, contains(url, '.example.') AS in_scope, NOT contains(url, '#') AS plain, sha256(url) > '8' AS upper_half FROM pages""")
def response_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertion columns over URLs."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").contains(".example.").alias("in_scope"), (~F.col("url").contains("#")).alias("plain"), (F.sha2("url", 256) > "8").alias("upper_half"))


@query("""
SELECT count(*) FILTER (WHERE n_chars BETWEEN 20 AND 5000) AS eligible, count(*) FILTER (WHERE n_chars < 20) AS short, count(*) FILTER (WHERE n_chars > 5000) AS long,
  count(*) FILTER (WHERE contains(text, '|')) AS tables, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents""")
def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a report in one scan."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").agg(F.count_if(n.between(20, 5000)).alias("eligible"), F.count_if(n < 20).alias("short"), F.count_if(n > 5000).alias("long"), F.count_if(F.col("text").contains("|")).alias("tables"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
