"""Target-distribution importance resampling (operator 12).

Documents are drawn that look like a target. Features are runs of words, hashed to
buckets; a bucket's gain is the log of how much more often the target has it than all
documents do, both smoothed by one. A document's weight is the mean gain of its features,
and noise that depends on its id alone turns the highest scores into a random draw
by weight.

Equal texts are collapsed first: texts are grouped whole (copies are combined before
the shuffle), each is cut into features once, its buckets count as often as it has
copies, and it is weighed once. Weights go back to the documents along the text's
digest; where a text has so many copies that they would meet in one task, its weight is
broadcast instead. Only then comes the noise of each document. Ranks come from a sort by
ranges and the sizes of the ranges, so no task sees all documents.

Defined results: a null or empty text, or one without words, has no features, weight 0
and its noise. A null id has the noise of an empty one. Texts of any length are taken
whole. Equal scores go to the smaller id, null ids first; rows that are equal in all
this are drawn in any order, they can't be told apart. Repeated rows are documents of
their own. An empty table gives an empty result; an empty target makes all rare features gain.
Other columns pass through; output columns replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.storage import join_hot, lower_ascii, settle, table, unused

#: Words are runs of other characters than these.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text: Column, longest: int, n_buckets: int) -> tuple[Column, Column]:
    """The number of words of ``text`` and the buckets of its runs of up to ``longest`` words, repeats included."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    bucket = lambda feature: F.pmod(F.crc32(feature.cast("binary")), F.lit(n_buckets)).cast("int")

    def runs(w: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

        longer = [of(n) for n in range(2, longest + 1)]
        return F.struct(F.size(w).alias("n_words"), F.transform(F.concat(w, *longer) if longer else w, bucket).alias("buckets"))

    # as the one element of an array the words are cut once, not for each use
    both = F.transform(F.array(words), runs)[0]
    return both["n_words"], both["buckets"]


def collapsed(rows: DataFrame, text_col: str, longest: int, n_buckets: int) -> DataFrame:
    """(digest, copies, n_words, buckets) of each distinct text, from rows with ``digest``; settled."""
    whole = rows.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("whole")).agg(F.count("*").alias("copies"))
    n_words, buckets = features(F.col("whole"), longest, n_buckets)
    return settle(whole.select(F.sha2("whole", 256).alias("digest"), "copies", n_words.alias("n_words"), buckets.alias("buckets")))


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all copies of the texts."""
    return texts.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """One row: ``gains``, an array of the gain of each bucket."""
    both = bucket_counts(source).withColumnRenamed("n", "s").join(bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "full_outer")
    every = source.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").na.fill(0)
    totals = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1).cast("double") * (F.col("all_s") + n_buckets).cast("double") / ((F.col("s") + 1).cast("double") * (F.col("all_t") + n_buckets).cast("double"))
    gain = F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "gain")))  # n_buckets elements, a parameter
    return every.crossJoin(F.broadcast(totals)).select("bucket", gain).agg(F.transform(ordered, lambda b: b["gain"]).alias("gains"))


def noise(id_: Column, seed: int) -> Column:
    """A draw from the Gumbel distribution, in thousandths, that depends on the id alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their place, from 1, in the order; by ranges, whose sizes alone are added up."""
    part, at = unused(rows, "_part"), unused(rows, "_at")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    # the number has the partition above its lower 33 bits
    placed = settle(placed.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy(part).count().collect()  # a row for each partition
    before, starts = 0, []
    for p, n in sorted(tuple(r) for r in sizes):
        starts.append((p, before))
        before += n
    start = unused(placed, "_start")
    return placed.join(F.broadcast(rows.sparkSession.createDataFrame(starts, f"{part} long, {start} long")), part).withColumn(rank, F.col(at) + F.col(start) + 1).drop(part, at, start)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, n_buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep_text: bool = True
) -> DataFrame:
    """``docs`` with n_features, weight, score and rank; drawn are the rows whose rank isn't null.

    ``percent`` of the documents of at least ``min_words`` words are drawn. Without
    ``keep_text`` the text column is left out, and texts are shuffled once only.
    """
    outputs = ("n_features", "weight", "score", "rank")
    digest, few = unused(docs, "_digest"), unused(docs, "_few")
    passed = [c for c in docs.columns if c.lower() not in outputs and (keep_text or c != text_col)]
    rows = docs.select(*(F.col(f"`{c}`") for c in passed), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(digest))
    source = collapsed(docs, text_col, longest, n_buckets)
    gained = settle(gains(source, collapsed(target, target_col, longest, n_buckets), n_buckets))
    n = F.size("buckets")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get("gains", b))
    weighed = source.crossJoin(F.broadcast(gained)).select(
        F.col("digest").alias(digest), "copies", n.cast("long").alias("n_features"), F.when(n > 0, (total - F.pmod(total, n)) / n).otherwise(0).cast("long").alias("weight"), (F.col("n_words") < min_words).alias(few)
    )
    weighed = settle(weighed.withColumnRenamed("copies", copies := unused(docs, "_copies")))
    counts = weighed.agg(F.sum(copies), F.sum(F.when(~F.col(few), F.col(copies)))).first()
    n_drawn = percent * (counts[1] or 0) // 100
    scored = join_hot(rows, weighed, digest, copies, counts[0] or 0).withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).drop(digest)
    order = [F.asc(few), F.desc("score"), F.asc_nulls_first(id_col), F.desc("n_features")]
    return ranked(scored, order, "rank").withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank"))).drop(few)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark"), keep_text=False)


OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
m AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, unnest(words) AS w FROM d),
mw AS MATERIALIZED (SELECT unnest(words) AS w FROM m),
bucket AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda acc, x: xor(acc >> 8, t[(xor(acc, x) % 256) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM mw)) CROSS JOIN crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN bucket ON bucket.w = dw.w GROUP BY b),
t AS (SELECT b, count(*) AS t FROM mw JOIN bucket ON bucket.w = mw.w GROUP BY b),
g AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT b FROM bucket) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN bucket ON bucket.w = dw.w JOIN g ON g.b = bucket.b GROUP BY doc_id),
f AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS total FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * total // 100 THEN place END AS rank FROM r
"""
