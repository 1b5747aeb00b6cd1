"""Near duplicates: an exact n-gram Jaccard join by signature trees (operator 3).

Texts are sets of five-word shingles; two link at a Jaccard similarity of 0.75
or more. The result is the component of links of every document, and it is
exact: no link between different sets is lost.

1. Every text becomes the size of its set and a key of it. Equal sets are one
   class from here on, so exact copies cost one class however many there are.
2. The classes' shingle hashes are dealt out into buckets of hash space, packed
   in binary columns. Within a bucket, shingles of a single class are dropped:
   they can't be in any overlap. What is left goes back to the classes, packed by
   groups of them; a class of which less than three quarters are left can't link
   with anything. Shingles that a sample of texts shows to be common are dealt out
   by class and count as shared, the most frequent ones of all; that spares the
   bucket they would meet in and changes no result.
3. Two linked sets have a common shingle among the rarest quarter of either. The
   classes are joined to blocks along these shingles (to the first class of each,
   not pairwise); links exist within blocks only.
4. Within a block a signature tree is traversed against itself. Pairs of nodes are
   passed over where sizes or bitmaps exclude a link or where all sets are already
   in one group. Blocks beyond ``TILE`` sets are cut into tiles: each tile alone,
   then one leader of each tile. What is not together then meets once more: along
   each rare shingle that several groups have, for only there can a link be, or, if
   that takes fewer copies of sets, all outside the block's largest group meet all.

Identity is by hash: 48 bits for a shingle within overlaps (one wrong overlap
in about 10^9 pairs of 300 shingles), 128 bits for a set: 64 that stand for it,
and 64 more that are compared; sets that agree in the first only are told apart.

Defined results: null texts count as empty; a text without words has no set,
is its own component and has ``n_shingles`` 0. A component's id is the least id
of its documents that is not null. Repeated rows are exact copies. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.components import components
from lexiforge.llm.hashing import mixed, shingle_sets
from lexiforge.llm.signature_tree import Groups, SignatureTree, links
from lexiforge.llm.storage import broadcast_few, gathered, join_hot, settle, table, unused

WIDTH = 5
NEED = (75, 100)
#: Shingles that a bucket of hash space is sized for.
BUCKET_SHINGLES = 3_000_000
#: Parts in which a bucket's shingles are unpacked.
PARTS = 16
#: Texts sampled for common shingles, and tasks that count them; those in one of ``COMMON`` of them are, at most MOST_COMMON.
SAMPLED_TEXTS, SAMPLE_TASKS, COMMON, MOST_COMMON = 20_000, 8, 500, 65_536
#: Sets whose keys agree by chance, at most; about one is expected among 10^10 sets.
MOST_AGREEING = 10_000
#: Shingles of fewer sampled texts are not common.
HOT_TEXTS = 40
#: The frequency that common shingles count for.
EVERYWHERE = np.uint32(0xFFFFFFFF)
#: Sets of one block that one task compares at once.
TILE = 512
#: Candidates that a task is sized for.
SETS_A_TASK = 10_000
#: Bytes of sets that one task of small blocks is sized for.
PACK_BYTES = 8_000_000


def set_key(ids: np.ndarray, seed: int = 101) -> int:
    """A set's key: a 64-bit sum that doesn't depend on order; signed, as Spark's long."""
    return int((mixed(ids, seed).sum(dtype=np.uint64) + np.uint64(len(ids))).astype(np.int64))


def told_apart(ids: np.ndarray, agreeing: frozenset[int]) -> int:
    """The key, or the second one where the first stands for several sets."""
    key = set_key(ids)
    return set_key(ids, 202) if key in agreeing else key


def pack(ids: np.ndarray) -> bytes:
    """48-bit values in six bytes each."""
    return np.ascontiguousarray(ids.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes | pa.Buffer) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view("<u8").astype(np.uint64)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, second) of every row."""

    @F.arrow_udf("n long, key long, second long")
    def sizes(texts: pa.Array) -> pa.Array:
        n, keys, seconds = [], [], []
        for sets in shingle_sets(texts, WIDTH):
            n += [len(s) for s in sets]
            keys += [set_key(s) for s in sets]
            seconds += [set_key(s, 202) for s in sets]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, keys, seconds)], ["n", "key", "second"])

    rows = docs.select(F.col(id_col).alias("id"), sizes(F.col(text_col)).alias("s"))
    return rows.select("id", "s.n", "s.key", "s.second")


def common_shingles(docs: DataFrame, text_col: str, rows: int) -> np.ndarray:
    """Shingles of more than one in ``COMMON`` texts of a sample, sorted; a bounded number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {set_key(s): s for batch in batches for block in shingle_sets(batch.column(0), WIDTH) for s in block}
        ids, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]) >> np.uint64(16), return_counts=True)
        often = n > max(HOT_TEXTS // SAMPLE_TASKS, len(sets) // COMMON)
        yield pa.RecordBatch.from_arrays([pa.array(ids[often].astype(np.int64)), pa.array(n[often])], ["shingle", "n"])

    sample = docs if rows <= SAMPLED_TEXTS else docs.sample(SAMPLED_TEXTS / rows, 1)
    counts = sample.select(text_col).repartition(SAMPLE_TASKS).mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") > max(HOT_TEXTS, min(rows, SAMPLED_TEXTS) // COMMON)).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON)
    return np.sort(np.array([r.shingle for r in often.collect()], np.uint64))


BLOB = "keys binary, sizes binary, runs binary, ids binary"


def runs_of(values: np.ndarray) -> list[int]:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))).tolist()


def blob(keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
    """Shingles in the order of their classes, packed: each class's key and size once, with the number of its shingles."""
    begins = runs_of(keys)
    return {"keys": keys[begins].astype(np.int64).tobytes(), "sizes": sizes[begins].astype(np.uint32).tobytes(), "runs": np.diff(begins, append=len(ids)).astype(np.uint32).tobytes() if begins else b"", "ids": pack(ids)}


def unblob(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sizes, ids) of each shingle of all blobs."""
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows[name]]
    runs = np.concatenate(read("runs", np.uint32))
    return np.repeat(np.concatenate(read("keys", np.int64)), runs), np.repeat(np.concatenate(read("sizes", np.uint32)), runs), np.concatenate([unpack(x.as_buffer()) for x in rows["ids"]])


def in_parts(rows: pa.Table) -> Iterator[pa.Table]:
    """The blobs of a bucket, some at a time."""
    step = max(1, -(-rows.num_rows // PARTS))
    return (rows.slice(a, step) for a in range(0, rows.num_rows, step))


def repeated_ids(rows: pa.Table) -> np.ndarray:
    """The shingles that stand in the blobs more than once, sorted; no more than the shingles themselves is held."""
    every, at = np.empty(sum(len(x.as_buffer()) for x in rows["ids"]) // 6, np.uint64), 0
    for x in rows["ids"]:
        ids = unpack(x.as_buffer())
        every[at : at + len(ids)] = ids
        at += len(ids)
    every.sort()
    return np.unique(every[1:][every[1:] == every[:-1]])


def is_in(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_, values)
    at[at == len(sorted_)] = 0
    return sorted_[at] == values


def dealt(docs: DataFrame, text_col: str, n_buckets: int, common: np.ndarray, agreeing: frozenset[int]) -> DataFrame:
    """(bucket, blob): the shingles of each bucket of hash space, from many texts at a time; ``common`` ones by class."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in shingle_sets(batch.column(0), WIDTH):
                classes = {told_apart(s, agreeing): s for s in sets if len(s)}
                if not classes:
                    continue
                keys = np.fromiter(classes, np.int64, len(classes))
                sizes = np.array([len(s) for s in classes.values()], np.uint32)
                ids = np.concatenate(list(classes.values())) >> np.uint64(16)
                owner = np.repeat(np.arange(len(keys)), sizes)
                bucket = (ids * np.uint64(n_buckets)) >> np.uint64(48)
                often = is_in(ids, common)
                bucket[often] = mixed(keys[owner[often]].astype(np.uint64), 3) % np.uint64(n_buckets)
                order = np.argsort(bucket.astype(np.uint32), kind="stable")
                ids, owner, bucket = ids[order], owner[order], bucket[order]
                begins = runs_of(bucket)
                out = [{"bucket": int(bucket[a])} | blob(keys[owner[a:b]], sizes[owner[a:b]], ids[a:b]) for a, b in zip(begins, [*begins[1:], len(ids)])]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "runs", "ids"))]))

    return docs.select(text_col).mapInArrow(deal, f"bucket int, {BLOB}")


def shared_shingles(blobs: DataFrame, n_buckets: int, n_groups: int, common: np.ndarray) -> DataFrame:
    """(group, blob, df): the shingles that two classes or more have, and how many have them, dealt by groups of classes.

    A bucket gives one row to each group of classes, not to each class.
    """

    def keep(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        # most shingles are of one class: only the others are unpacked with their classes
        stay, found = np.union1d(repeated_ids(rows), common), []
        for keys, sizes, ids in map(unblob, in_parts(rows)):
            told = is_in(ids, stay)
            found.append((keys[told], sizes[told], ids[told]))
        keys, sizes, ids = map(np.concatenate, zip(*found))
        del found
        order = np.lexsort((keys, ids))
        keys, sizes, ids = keys[order], sizes[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])  # a class may come from several tasks
        keys, sizes, ids = keys[new], sizes[new], ids[new]
        have = np.diff(runs_of(ids), append=len(ids)) if len(ids) else np.zeros(0, np.int64)
        df = np.repeat(have, have).astype(np.uint32)
        df[is_in(ids, common)] = EVERYWHERE
        keys, sizes, ids, df = keys[df > 1], sizes[df > 1], ids[df > 1], df[df > 1]
        group = (keys.astype(np.uint64) % np.uint64(n_groups)).astype(np.int64)
        order = np.lexsort((keys, group))
        keys, sizes, ids, df, group = keys[order], sizes[order], ids[order], df[order], group[order]
        begins = runs_of(group)
        out = [{"group": int(group[a])} | blob(keys[a:b], sizes[a:b], ids[a:b]) | {"df": df[a:b].tobytes()} for a, b in zip(begins, [*begins[1:], len(ids)])]
        return pa.Table.from_pylist(out, pa.schema([("group", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "runs", "ids", "df"))]))

    # as many partitions as buckets: a task has few of them, at any size
    return blobs.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(keep, f"group int, {BLOB}, df binary")


def candidates(shared: DataFrame, n_groups: int) -> DataFrame:
    """(key, n, ids, prefix): classes that may link; their shared shingles in order; the rarest of them that a partner must meet."""

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, sizes, ids = unblob(rows)
        df = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows["df"]])
        order = np.argsort(keys, kind="stable")
        keys, sizes, ids, df = keys[order], sizes[order], ids[order], df[order]
        out = {"key": [], "n": [], "ids": [], "prefix": []}
        begins = runs_of(keys)
        for a, b in zip(begins, [*begins[1:], len(keys)]):
            size, m = int(sizes[a]), b - a
            if NEED[1] * m < NEED[0] * size:
                continue
            least = -(-NEED[0] * size // NEED[1])  # no partner has fewer in common
            length = size - least + 1 - (size - m)  # the shingles of this class alone come first
            rarest = np.lexsort((ids[a:b], df[a:b]))[: max(0, length)]
            out["key"].append(int(keys[a]))
            out["n"].append(size)
            out["ids"].append(pack(np.sort(ids[a:b])))
            out["prefix"].append(ids[a:b][rarest].astype(np.int64))
        return pa.table(out, pa.schema([("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("prefix", pa.list_(pa.int64()))]))

    return shared.repartition(n_groups, "group").groupBy("group").applyInArrow(gather, "key long, n long, ids binary, prefix array<long>")


def in_blocks(sets: DataFrame) -> DataFrame:
    """(block, key, n, ids, prefix) of the classes that meet another one along a rare shingle."""
    postings = sets.select("key", F.explode("prefix").alias("shingle"))
    hubs = settle(postings.groupBy("shingle").agg(F.min("key").alias("hub"), F.max("key").alias("other"), F.count("*").alias("size")).where("hub <> other"))
    total = hubs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    edges = join_hot(postings, hubs.select("shingle", "hub", "size"), "shingle", "size", total).select(F.col("hub").alias("a"), F.col("key").alias("b"))
    blocks = components(edges)
    return blocks.join(sets, blocks.v == sets.key).select(F.col("label").alias("block"), "key", "n", "ids", "prefix")


LINK = "a long, b long"


def as_links(pairs: list[tuple[int, int]], keys: np.ndarray) -> pa.Table:
    ends = keys[np.array(pairs, np.int64).reshape(-1, 2)]
    return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})


def links_within(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the sets of each ``part`` of ``rows`` (task, part, side, key, n, ids, label) to its components.

    Sets of one ``label`` are together already. Where a part has two sides, links are
    looked for between these only.
    """

    def inside(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, sizes, ids = rows["key"].to_numpy(), rows["n"].to_numpy(), rows["ids"].combine_chunks()
        parts, sides = rows["part"].to_numpy(), rows["side"].to_numpy()
        groups = Groups(rows["label"].to_numpy())
        order = np.argsort(parts, kind="stable")
        cuts = np.flatnonzero(np.diff(parts[order])) + 1
        found = []
        for own in np.split(order, cuts):
            tree = lambda which: SignatureTree([unpack(ids[i].as_buffer()) for i in which.tolist()], sizes[which], which)
            left = own[sides[own] == sides[own].min()]
            one = tree(left)
            found += links(one, one if len(left) == len(own) else tree(own[sides[own] != sides[own].min()]), groups, NEED)
        return as_links(found, keys)

    return rows.select("task", "part", "side", "key", "n", "ids", "label").groupBy("task").applyInArrow(inside, LINK)


def packed(rows: DataFrame, part: Column, sizes: DataFrame) -> DataFrame:
    """``rows`` with small parts put together to tasks of about ``PACK_BYTES``; ``sizes`` has the ``bytes`` of each row."""
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return rows.withColumns({"part": part, "task": F.pmod(part, F.lit(max(1, -(-total // PACK_BYTES))))})


def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their key's component under ``edges``."""
    named = components(edges)
    return rows.join(named.select(F.col("v").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def large_block_links(rows: DataFrame) -> DataFrame:
    """Links that join the components of blocks of more than TILE sets; rows: (block, tile, key, n, ids, prefix)."""
    of_tile = lambda df: df.withColumns({"part": F.xxhash64("block", "tile"), "task": F.xxhash64("block", "tile"), "side": F.lit(0), "label": F.col("key")})
    alone = settle(links_within(of_tile(rows)))
    first = settle(labelled(rows, alone))
    # a leader for each tile's largest group; TILE tiles' leaders meet in one task
    size = first.groupBy("block", "tile", "label").agg(F.count("*").alias("size"), F.min("key").alias("key"))
    leader = size.groupBy("block", "tile").agg(F.max_by("key", "size").alias("key"))
    leaders = leader.join(rows.drop("block", "tile"), "key").withColumn("tile", F.floor(F.col("tile") / TILE))
    edges = settle(alone.union(links_within(of_tile(leaders))))
    second = settle(labelled(rows, edges))
    main = second.groupBy("block", "label").agg(F.count("*").alias("size")).groupBy("block").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("together"))
    # a link between two groups is between sets that have a rare shingle in common
    postings = second.select("block", "key", "label", F.explode("prefix").alias("shingle"))
    lists = postings.groupBy("block", "shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), *[F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(20,0)")).alias(f"sum{k}") for k in (1, 2)]).where("low <> high")
    # of shingles that the same sets have, one is enough
    lists = settle(lists.groupBy("block", "size", "sum1", "sum2").agg(F.min("shingle").alias("shingle")).withColumn("tiles", F.ceil(F.col("size") / TILE)))
    # copies of sets that meet along shingles, and that meet if all outside the largest group meet all: whatever is less, by block
    costs = lists.groupBy("block").agg(F.sum(F.col("size") * F.col("tiles")).alias("along")).join(main, "block")
    costs = costs.withColumns({"chunks": F.ceil((F.col("all") - F.col("together")) / TILE), "tiles": F.ceil(F.col("all") / TILE)})
    costs = settle(costs.withColumn("around", (F.col("all") - F.col("together")) * F.col("tiles") + F.col("all") * F.col("chunks")))
    narrow = second.select("block", "key", "label")
    meeting = along_shingles(postings, lists.join(broadcast_few(costs.where("along <= around").select("block")), "block", "left_semi"))
    meeting = meeting.union(around_the_rest(narrow, costs.where("along > around").select("block", "main", "chunks", "tiles")))
    meeting = settle(meeting)
    # a set meets others in many parts: tasks are sized by its copies
    copies = meeting.join(second.select("key", F.octet_length("ids").alias("bytes")), "key")
    sets = meeting.join(second.select("key", "label", "n", "ids"), "key")
    return edges.union(links_within(packed(sets, F.col("met"), copies)))


MEET = ("key", "side", "met")


def along_shingles(postings: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, side, met): the sets of each shingle of ``lists``; where they are many, in tiles of which each two meet."""
    lists = settle(lists.select(F.xxhash64("block", "shingle").alias("list"), "size", "tiles"))
    total = lists.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = join_hot(postings.select("key", F.xxhash64("block", "shingle").alias("list")), lists, "list", "size", total)
    own = own.withColumn("side", F.pmod(F.xxhash64("key", F.lit(5)), F.col("tiles")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return pairs.withColumn("met", F.xxhash64("list", F.least("side", "other"), F.greatest("side", "other"))).withColumn("side", F.col("side").cast("int")).select(*MEET)


def around_the_rest(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, side, met): the sets outside a block's largest group in chunks, each of which meets each tile of all its sets."""
    own = sets.join(broadcast_few(blocks), "block").withColumns({"chunk": F.pmod(F.xxhash64("key", F.lit(5)), F.col("chunks")), "tile": F.pmod(F.xxhash64("key", F.lit(6)), F.col("tiles"))})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = own.where("label <> main").withColumns({"tile": upto("tiles"), "side": F.lit(1)})
    every = own.withColumns({"chunk": upto("chunks"), "side": F.lit(0)})
    return rest.unionByName(every).withColumn("met", F.xxhash64("block", "tile", "chunk")).select(*MEET)


def link_edges(blocks: DataFrame) -> DataFrame:
    """Links that join the classes of each block to its components."""
    blocks = settle(blocks)
    sizes = settle(blocks.groupBy("block").agg(F.count("*").alias("size")))
    rows = blocks.join(sizes, "block")
    small = rows.where(F.col("size") <= TILE).withColumns({"side": F.lit(0), "label": F.col("key")})
    large = rows.where(F.col("size") > TILE).withColumn("tile", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / TILE)))
    edges = links_within(packed(small, F.col("block"), small.select(F.octet_length("ids").alias("bytes"))))
    if not sizes.where(F.col("size") > TILE).isEmpty():
        edges = edges.union(large_block_links(gathered(settle(large.select("block", "tile", "key", "n", "ids", "prefix")), SETS_A_TASK // 2)))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``."""
    rows = settle(measured(docs, id_col, text_col))
    n_rows = rows.count()
    own = [F.min("id").alias("first"), F.max("n").alias("n"), F.count("*").alias("copies"), F.min("second").alias("low"), F.max("second").alias("high")]
    classes = settle(rows.groupBy("key").agg(*own))
    agreeing = [r.key for r in classes.where("low <> high").select("key").limit(MOST_AGREEING + 1).collect()]
    if len(agreeing) > MOST_AGREEING:
        raise ValueError("too many sets have the same key")
    if agreeing:
        rows = rows.withColumn("key", F.when(F.col("key").isin(agreeing), F.col("second")).otherwise(F.col("key")))
        classes = settle(rows.groupBy("key").agg(*own))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_SHINGLES))
    common, agreeing = common_shingles(docs, text_col, n_rows), frozenset(agreeing)
    shared = shared_shingles(dealt(docs, text_col, buckets, common, agreeing), buckets, 2 * buckets, common)
    sets = gathered(settle(candidates(shared, 2 * buckets)), SETS_A_TASK)
    found = components(link_edges(in_blocks(sets)))
    joined = classes.join(found, classes.key == found.v)
    least = settle(joined.groupBy("label").agg(F.min("first").alias("component"), F.count("*").alias("size")))
    named = join_hot(joined.select("key", "label"), least, "label", "size", n_rows).select("key", "component")
    class_of = settle(classes.join(named, "key", "left").select("key", F.coalesce("component", "first").alias("component"), "copies"))
    return join_hot(rows, class_of, "key", "copies", n_rows).select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose component has a document of lower id; texts without words stay."""
    found = near_duplicates(docs, id_col, text_col)
    kept_id = unused(docs, "_kept")
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(kept_id)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[kept_id]), "left_semi")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT * FROM s WHERE shingle IN (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1)),
e AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shared x JOIN shared y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT e.b AS v, r.c FROM r JOIN e ON e.a = r.v AND r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) m ON m.v = w.doc_id
"""
