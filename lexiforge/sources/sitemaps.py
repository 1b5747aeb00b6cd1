"""Site maps as files: one XML document a shard, no shard above its cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import escaped

#: The most URLs that a site map may have.
CAP = 50_000
HEAD, FOOT = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"


def entry(url: Column) -> Column:
    return F.concat(F.lit("<url><loc>"), escaped(url), F.lit("</loc></url>"))


def write_sitemaps(urls: DataFrame, folder: str, shard: str = "shard", url: str = "url", cap: int = CAP) -> DataFrame:
    """(shard, urls, written): writes ``shard=n`` folders with one document each, in the order of URLs; a shard above the cap is not written.

    A document is put together in one task, from at most ``cap`` URLs; shards that are too large are known by their counts before.
    """
    counted = urls.where(F.col(url).isNotNull()).groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("urls"))
    verdicts = counted.withColumn("written", F.col("urls") <= cap)
    fit = urls.where(F.col(url).isNotNull()).join(verdicts.where("written").select(F.col("shard").alias(shard)), shard, "left_semi")
    documents = fit.groupBy(F.col(shard).alias("shard")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(url)), entry), "").alias("entries"))
    documents.select(F.concat(F.lit(HEAD), "entries", F.lit(FOOT)).alias("value"), "shard").write.mode("error").partitionBy("shard").text(folder)
    return verdicts


def read_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, value): the documents."""
    return spark.read.schema("value string, shard int").text(folder, wholetext=True).withColumn("value", F.regexp_replace("value", r"\n\z", ""))
