"""Sources and sinks: Parquet tables, line JSON, content-addressed files, schema fallback."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of heavy work on each row is sized for.
ROWS_A_TASK = 50_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt anew by ``keys``, for work that is heavy where their files are small: a small file is read by one task."""
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_TASK)), *keys)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType, longest_line: int = 1 << 20) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a malformed or overlong line fails the read, with its file and beginning."""
    lines = spark.read.text(path).select("value", "_metadata.file_name").where(F.trim("value") != "")
    named = lambda why: F.raise_error(F.concat(F.lit(f"{why} in "), "file_name", F.lit(": "), F.left("value", F.lit(80))))
    sized = F.when(F.octet_length("value") > longest_line, named("a line is too long")).when(F.try_parse_json("value").isNull(), named("a malformed line")).otherwise(F.col("value"))
    return lines.withColumn("value", sized).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_ndjson(df: DataFrame, path: str, *keys: str) -> None:
    """Rows in key order, one JSON object a line; nulls are written."""
    df.orderBy(*keys).write.option("ignoreNullFields", "false").mode("error").json(path)


#: Rows that a bucket of content_digest is sized for.
BUCKET_ROWS = 100_000


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, sha256) that don't depend on row order: rows are digested, digests are sorted and digested by bucket, and then the buckets.

    The buckets are prefixes of the row digests, two more digits for each 256 times as many rows, so none holds many.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    hashed, digits = df.select(row.alias("h")), 2
    n = df.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 2
    folded = hashed.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    while digits > 2:
        digits -= 2
        folded = folded.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return folded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def export_snapshot(df: DataFrame, folder: str, *keys: str) -> DataFrame:
    """Rows in key order as line JSON in ``folder``, with a manifest; (rows, sha256, replayed).

    The rows are written beside the folder and moved there in one step, so a reader sees
    all or nothing. If an export of the same content is there, it is left as it is
    (``replayed``); one of other content is an error.
    """
    spark = df.sparkSession
    there, files = hadoop_path(spark, folder)
    digest = content_digest(df).first()
    manifest = spark.createDataFrame([tuple(digest)], "rows long, sha256 string")
    if files.exists(there):
        known = spark.read.schema("rows long, sha256 string").json(f"{folder}/manifest").first()
        if tuple(known) != tuple(digest):
            raise ValueError(f"{folder} has another export")
        return manifest.withColumn("replayed", F.lit(True))
    beside = f"{folder}.{uuid.uuid4().hex}"
    write_ndjson(df, f"{beside}/rows", *keys)
    manifest.coalesce(1).write.json(f"{beside}/manifest")
    if not files.rename(hadoop_path(spark, beside)[0], there):
        raise OSError(f"{folder} could not be put in place")
    return manifest.withColumn("replayed", F.lit(False))


def put_artifacts(texts: DataFrame, folder: str, column: str = "text") -> DataFrame:
    """Writes each distinct text under its digest (fan-out by the first two digits), unless it is there; returns (sha256, path)."""
    spark = texts.sparkSession
    named = texts.where(F.col(column).isNotNull()).groupBy(F.sha2(column, 256).alias("sha256")).agg(F.first(column).alias("value"))
    there, files = hadoop_path(spark, folder)
    new = named.join(stored_artifacts(spark, folder).select("sha256"), "sha256", "left_anti") if files.exists(there) else named
    new.select("sha256", "value", F.substring("sha256", 1, 2).alias("fan")).write.mode("append").partitionBy("fan").parquet(folder)
    return named.select("sha256", F.concat(F.lit(f"{folder}/fan="), F.substring("sha256", 1, 2)).alias("path"))


def stored_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("sha256 string, value string, fan string").parquet(folder)


def verify_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored texts whose digest isn't their name or that lie in another's folder; no rows if all is well."""
    return stored_artifacts(spark, folder).where((F.sha2("value", 256) != F.col("sha256")) | (F.substring("sha256", 1, 2) != F.col("fan")))


def write_extract(df: DataFrame, path: str, key: str, files: int = 16) -> None:
    """A sorted extract for key lookups: files hold ranges of the key, so statistics prune them."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("error").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key; statistics of the sorted files leave all other files out."""
    return spark.read.parquet(path).where(F.col(key) == value)


def lookup_all(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows of an extract for each row of ``wanted``, whose columns are the key."""
    return spark.read.parquet(path).join(wanted, wanted.columns)
