"""Exact deduplication behind static binary fuse filters (operator 2).

The rows are an immutable snapshot and an incoming batch. Texts become SHA-256
digests of their normalised bytes; each side's digests are grouped on their own
(the batch's own duplicates never meet the snapshot). For each bucket of the
snapshot's digests one 3-wise binary fuse filter is built. The batch's distinct
digests are screened by the filter of their bucket; only positives are joined
with the exact digests, and the two representatives' normalised texts are
compared byte for byte before the groups become one. A snapshot's digests and
filters can be written once (``write_snapshot``) and screen every later batch
(``known_texts``) without being built again.

Defined results: null texts count as empty and are equal to empty ones. Of
equal texts the row with the largest id stays; null ids lose against all others;
among rows that repeat an id and text, one (in scan order) stays. Ids may be of any
type that has an order. Empty tables give empty results. Copies are combined before
every shuffle, so a group that holds a third of all rows is one record from each
task. Rows are joined with their groups by digest; groups with many rows are broadcast
for that, of which there are at most a bounded number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.hashing import mixed
from lexiforge.llm.storage import broadcast_few, join_hot, lower_ascii, settle, table, unused

#: Distinct digests that one filter and one screening task are sized for.
DIGESTS_A_BUCKET = 200_000


class FuseFilter:
    """A static 3-wise binary fuse filter with 16-bit fingerprints: no false negatives, about 2^-16 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, table_: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table_

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots in consecutive segments, and the fingerprint."""
        h = mixed(keys, self.seed)
        start = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        g = mixed(h, 0x9E3779B97F4A7C15)
        mask = np.uint64(self.segment - 1)
        slots = np.stack([(start + np.uint64(i)) * np.uint64(self.segment) + ((g >> np.uint64(21 * i)) & mask) for i in range(3)]).astype(np.int64)
        return slots, (mixed(g, 1) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> "FuseFilter":
        keys = np.unique(keys)
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        segment = min(segment, 1 << 18)
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        for seed in range(1, 200):
            segments = max(1, int(np.ceil(n * factor * (1 + 0.02 * (seed // 10)) / segment)))
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint16))
            if made.fill(keys):
                return made
        raise RuntimeError("no seed gives a filter")

    def fill(self, keys: np.ndarray) -> bool:
        """Peel all keys round by round, then set fingerprints in reverse; False if the keys can't be peeled."""
        slots, prints = self.places(keys)
        size = len(self.table)
        index = np.arange(len(keys), dtype=np.int64)
        count = np.bincount(slots.ravel(), minlength=size)
        sums = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(sums, row, index)
        rounds, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            which, first = np.unique(sums[alone], return_index=True)
            own = alone[first]
            rounds.append((which, own))
            left -= len(which)
            touched = slots[:, which]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(sums, row, which)
            near = np.unique(touched.ravel())
            alone = near[count[near] == 1]
        if left:
            return False
        for which, own in reversed(rounds):
            a, b, c = self.table[slots[:, which]]
            self.table[own] = prints[which] ^ a ^ b ^ c ^ self.table[own]
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self.places(keys)
        a, b, c = self.table[slots]
        return (a ^ b ^ c) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "FuseFilter":
        seed, segment, segments = np.frombuffer(data, np.int64, 3).tolist()
        return cls(seed, segment, segments, np.frombuffer(data, np.uint16, offset=24))


def digest_keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest."""
    chunks = digests.chunks if isinstance(digests, pa.ChunkedArray) else [digests]
    parts = [np.frombuffer(c.cast(pa.binary(32)).buffers()[1], ">u8", 4 * len(c), 32 * c.offset)[::4] for c in chunks if len(c)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.uint64)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """(bucket, filter) from (bucket, digest)."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        made = FuseFilter.build(digest_keys(rows["digest"])).to_bytes()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming digests whose bucket's filter says that the snapshot may have them."""

    def positives(rows: pa.Table, kept: pa.Table) -> pa.Table:
        rows = rows.select(["bucket", "digest"])
        if not len(rows) or not len(kept):
            return rows.slice(0, 0)
        found = FuseFilter.from_bytes(kept["filter"][0].as_py()).has(digest_keys(rows["digest"]))
        return rows.filter(pa.array(found))

    pairs = incoming.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return pairs.applyInArrow(positives, "bucket int, digest binary")


def normalised(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", (F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long") % buckets).cast("int"))


def exact_groups(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, the digest, the id that stays, the group's size and whether this row stays."""
    text = normalised(text_col)
    narrow = settle(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old"), F.monotonically_increasing_id().alias("row")))
    # struct order puts null ids first, so a null id is the largest only if all are null
    groups = narrow.groupBy("digest", "old").agg(F.count("*").alias("size"), F.max(F.struct("id", F.negate("row").alias("back"))).alias("top"))
    groups = settle(groups)
    groups = bucketed(groups, max(1, -(-groups.count() // DIGESTS_A_BUCKET)))
    snapshot, batch = groups.where("old"), groups.where("not old")
    maybe = screen(batch, build_filters(snapshot))
    both = maybe.join(snapshot.select("bucket", "digest", F.col("size").alias("size_old"), F.col("top").alias("top_old")), ["bucket", "digest"]).join(batch.select("bucket", "digest", F.col("size").alias("size_new"), F.col("top").alias("top_new")), ["bucket", "digest"])
    both = settle(both)
    wanted = broadcast_few(settle(both.select("digest", F.explode(F.array("top_old.id", "top_new.id")).alias("id")).where("id is not null")))
    bytes_ = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(wanted, "id")
    # an id may stand on several rows: the texts of this digest are those to compare
    equal = bytes_.where(F.unhex(F.sha2("text", 256)) == F.col("digest")).groupBy("digest").agg((F.min("text") == F.max("text")).alias("equal"))
    both = both.join(equal, "digest", "left").where(F.coalesce("equal", F.lit(True))).drop("bucket", "equal")
    joined = groups.drop("bucket").join(both, "digest", "left")
    # rows of the snapshot and of the batch are told apart in the key: texts of one digest might differ
    key = lambda: F.concat("digest", F.when(F.col("old"), F.lit("o")).otherwise(F.lit("n")).cast("binary"))
    merged = settle(joined.select(
        key().alias("key"),
        F.coalesce(F.col("size_old") + F.col("size_new"), F.col("size")).alias("group_size"),
        F.coalesce(F.greatest("top_old", "top_new"), F.col("top")).alias("keep"),
        F.col("size").alias("rows"),
    ))
    return join_hot(narrow.withColumn("key", key()), merged, "key", "rows", narrow.count()).select(
        "id",
        "digest",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep.id")) & (F.negate("row") == F.col("keep.back"))).alias("kept"),
    )


def older_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """True for the older half of the id range, which stands for the snapshot; of other than whole numbers, for half of the ids by their hash."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return F.coalesce(F.xxhash64(id_col) < 0, F.lit(False))
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(True) if low is None else F.col(id_col) <= (low + high) // 2


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another row's text. Whole rows are shuffled only where many go."""
    groups = exact_groups(docs, older_half(docs, id_col), id_col, text_col)
    # the id is part of the key, so that the rows of a large group spread over all tasks
    as_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    id_, digest = unused(docs, "_id"), unused(docs, "_digest")
    keys = groups.groupBy(as_key("id").alias(id_), F.col("digest").alias(digest)).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    keys = settle(keys.where("not kept or n > 1"))
    gone, repeated = (settle(keys.where(c).select(id_, digest)) for c in ("not kept", "kept"))
    keyed = docs.withColumns({digest: F.unhex(F.sha2(normalised(text_col), 256)), id_: as_key(id_col)})
    rows = keyed.join(broadcast_few(gone), [digest, id_], "left_anti")
    if not repeated.isEmpty():  # rows of one id and text: one of them stays
        of_some = lambda how: rows.join(broadcast_few(repeated), [digest, id_], how)
        rows = of_some("left_anti").union(of_some("left_semi").dropDuplicates([digest, id_]))
    return rows.drop(digest, id_)


def write_snapshot(docs: DataFrame, folder: str, text_col: str = "text") -> None:
    """The snapshot's distinct digests, with a text each, and their filters, as tables in ``folder``."""
    text = normalised(text_col)
    digests = settle(docs.groupBy(F.unhex(F.sha2(text, 256)).alias("digest")).agg(F.first(text).alias("text")))
    digests = bucketed(digests, max(1, -(-digests.count() // DIGESTS_A_BUCKET)))
    digests.write.mode("error").parquet(f"{folder}/digests")
    build_filters(digests).write.mode("error").parquet(f"{folder}/filters")


def known_texts(batch: DataFrame, folder: str, text_col: str = "text", known_col: str = "known") -> DataFrame:
    """``batch`` with whether its text is one of the written snapshot's: screened by the filters, then compared byte for byte."""
    spark = batch.sparkSession
    filters, stored = (spark.read.parquet(f"{folder}/{name}") for name in ("filters", "digests"))
    buckets = stored.agg(F.coalesce(F.max("bucket") + 1, F.lit(1))).first()[0]
    digest = F.unhex(F.sha2(normalised(text_col), 256))
    maybe = screen(bucketed(batch.select(digest.alias("digest")).distinct(), buckets), filters)
    own, text = unused(batch, "_digest"), unused(batch, "_known_text")
    found = maybe.join(stored, ["bucket", "digest"]).select(F.col("digest").alias(own), F.col("text").alias(text))
    keyed = batch.withColumn(own, digest).join(found, own, "left")
    return keyed.withColumn(known_col, F.coalesce(F.col(text) == normalised(text_col), F.lit(False))).drop(own, text)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_groups(docs, older_half(docs))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
