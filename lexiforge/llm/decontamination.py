"""Benchmark decontamination by a prefix-filtered set join (operator 13).

A benchmark item is cut into windows of ten words (a shorter item is one window). A
window is the set of its shingles of five words, with their places. A document
contains a window only if it has all its shingles, so the overlap that is needed is the
whole set and the necessary prefix, in an order by rarity, is its single rarest shingle.

1. Windows of equal words become one, whichever items have them.
2. One pass over the documents hashes every shingle and keeps those that some window has,
   by a bit table of fixed size: for each such place a row with the words around it, at most
   as many as a window could reach. Wrong bits only cost rows that the join drops.
3. Rarity is how often a shingle occurs in the documents. Each window keeps its rarest;
   one that no document has can't occur and goes.
4. Places are joined with the prefix shingles. The window would have to begin as many
   words before as the shingle stands in it: windows that would begin before the document
   or end behind it are passed over (the positional and length bounds). The words
   at that place are then compared with the window's, as texts: hashes never decide.
5. For each document the covered words are counted and the items of its windows listed.

Only places of benchmark shingles are shuffled. Prefix shingles are broadcast if they
are few, else both sides are shuffled by shingle, of which adaptive execution splits hot ones.

Defined results: a null or empty text has no words, isn't hit, and as an item has no window. A
text of any length is taken whole; its places are rows of their own, so none is held as a
whole but the text itself. Repeated documents are judged alike, one row each; items of
equal id or text are counted by id, once; null ids of items are passed over in the list.
An empty table of either kind gives no hits. Other columns pass through, the text column
doesn't (unless asked for); output columns replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiforge.llm.hashing import blocks, byte_table, chained, cut_words, hashes_of
from lexiforge.llm.storage import broadcast_few, settle, table, unused

#: Bytes outside words: all ASCII but digits and letters.
SEPARATORS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: The bit table has two to this many bits (8 MB), however large the benchmark is.
BITS = 26
#: Bits of one of Spark's bitmaps.
BITMAP = 32_768
#: Places of shingles in a batch of rows.
PLACES = 10_000


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: bytes, begins, ends, hashes of words, and the first word of each text (and one more)."""
    for data, offsets in blocks(texts):
        if len(data):
            low, begins, ends = cut_words(data, offsets, SEPARATORS)
            yield low, begins, ends, hashes_of(low, begins, ends), np.searchsorted(begins, offsets)
        else:
            none = np.zeros(0, np.int64)
            yield data, none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64)


def joined(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> str:
    """Words, one space between them."""
    return b" ".join(low[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())).decode("utf-8", "replace")


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, words, size, width, shingles) for each window of each item; shingles are of ``width`` words."""

    def cut(batch: pa.RecordBatch) -> Iterator[tuple]:
        at = 0
        for low, begins, ends, hashes, first in words_of(batch.column(1)):
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                size = min(window, b - a)
                width = min(shingle, size)
                for s in range(a, b - size + 1) if size else ():
                    h = chained(hashes, np.arange(s, s + size - width + 1), width)
                    yield batch.column(0)[at + i].as_py(), joined(low, begins[s : s + size], ends[s : s + size]), size, width, h.view(np.int64).tolist()
            at += len(first) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            for rows in batched(cut(batch), PLACES):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["item", "words", "size", "width", "shingles"])

    return items.mapInArrow(run, "item string, words string, size int, width int, shingles array<long>")


def bit_table(windows: DataFrame) -> np.ndarray:
    """A table of 2 to the BITS bits, set for all shingles of the windows."""
    slot = F.shiftrightunsigned("shingle", 64 - BITS) + 1
    placed = windows.select(F.explode("shingles").alias("shingle")).groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for part, found in placed.collect():  # at most 2048 rows of 4 KB
        bits[(part - 1) * (BITMAP // 8) :][: BITMAP // 8] = np.frombuffer(found, np.uint8)
    return bits


def screened(docs: DataFrame, text_col: str, names: list[str], bits, widths: list[int], window: int) -> DataFrame:
    """Each row of ``docs`` with its number of words, and a row for each place of a shingle that some window has.

    ``names`` are the columns (row, n_words, place, shingle, before, around): a place's row has the words ``around`` it, ``before`` of them in front of it.
    """
    passed = [c for c in docs.columns if c != text_col]
    added = zip(names[1:], (T.LongType(), T.IntegerType(), T.LongType(), T.IntegerType(), T.StringType()))
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in docs.drop(text_col).schema] + [T.StructField(*a) for a in added])

    def places(rows: pa.Array, texts: pa.Array, counts: list[np.ndarray]) -> Iterator[tuple]:
        table, at = bits.value, 0
        for low, begins, ends, hashes, first in words_of(texts):
            counts.append(np.diff(first))
            for width in widths:
                if len(hashes) < width:
                    continue
                h = chained(hashes, np.arange(len(hashes) - width + 1), width)
                slot = h >> np.uint64(64 - BITS)
                found = np.flatnonzero((table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                doc = np.searchsorted(first, found, "right") - 1
                within = found + width <= first[doc + 1]  # a shingle ends in the text in which it begins
                for i, d in zip(found[within].tolist(), doc[within].tolist()):
                    a, b = max(first[d], i - (window - width)), min(first[d + 1], i + window)
                    yield rows[at + d].as_py(), int(first[d + 1] - first[d]), i - int(first[d]), int(h[i].astype(np.int64)), int(i - a), joined(low, begins[a:b], ends[a:b])
            at += len(first) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(nullable)
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            counts: list[np.ndarray] = []
            for held in batched(places(column(names[0]), column(text_col), counts), PLACES):
                found = dict(zip(names, zip(*held)))
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(len(held), f.type) for f in out], schema=out)
            if batch.num_rows:
                own = {c: column(c) for c in passed} | {names[1]: pa.array(np.concatenate(counts), pa.int64())}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(batch.num_rows, f.type) for f in out], schema=out)

    return docs.mapInArrow(run, nullable)


def covered(spans: Column) -> Column:
    """How many words lie in ``spans``, an array of (start, stop)."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("last")),
        lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["last"]))).cast("long").alias("sum"), F.greatest(s["last"], x["stop"]).alias("last")),
        lambda s: s["sum"],
    )


def rarest_shingles(windows: DataFrame, places: DataFrame) -> DataFrame:
    """(shingle, window, offset, size, words): the rarest shingle of each window all of whose shingles occur."""
    often = places.groupBy("shingle").agg(F.count("*").alias("often"))
    each = windows.select("window", F.posexplode("shingles").alias("offset", "shingle")).join(often, "shingle", "left")
    first = each.groupBy("window").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "shingle")).alias("first")).where("first.often > 0")
    return first.join(windows, "window").select("first.shingle", "window", "first.offset", "size", "words")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text", keep_text: bool = False, spans_col: str | None = None, items_col: str | None = None
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    ``spans_col`` and ``items_col`` name columns for the hit spans (start and stop in words, as they were found, sorted) and the ids of the items.
    """
    outputs = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"} | {c.lower() for c in (spans_col, items_col) if c}
    source = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in outputs or c == text_col))
    names = []
    for name in ("_row", "n_words", "_place", "_shingle", "_before", "_around"):
        names.append(name if name == "n_words" else unused(source, name))
    row, n_words, place, shingled, before, around = names
    every = settle(item_windows(items.select(F.col(item_id_col).cast("string"), F.col(item_col).cast("string")), window, shingle))
    windows = settle(every.groupBy("words").agg(F.first("size").alias("size"), F.first("width").alias("width"), F.first("shingles").alias("shingles")).withColumn("window", F.monotonically_increasing_id()))
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # at most ``shingle`` of them
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(windows))
    text = unused(source, "_text")
    kept = source if keep_text else source.drop(text_col)
    numbered = source.select(*(F.col(f"`{c}`") for c in kept.columns), F.col(text_col).cast("string").alias(text), F.monotonically_increasing_id().alias(row))
    both = settle(screened(numbered, text, names, bits, widths, window))
    places = both.where(F.col(place).isNotNull()).select(F.col(row).alias("row"), F.col(n_words).alias("n"), F.col(place).alias("place"), F.col(shingled).alias("shingle"), F.col(before).alias("before"), F.col(around).alias("around"))
    prefixes = settle(rarest_shingles(windows, places))
    start, inside = F.col("place") - F.col("offset"), F.col("before") - F.col("offset")
    bounded = places.join(broadcast_few(prefixes), "shingle").where((start >= 0) & (start + F.col("size") <= F.col("n")) & (inside >= 0))
    same = F.array_join(F.slice(F.split("around", " "), inside + 1, F.col("size")), " ") == F.col("words")
    found = settle(bounded.where(same).select("row", "window", start.alias("start"), (start + F.col("size")).alias("stop")).distinct())
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    of_window = settle(every.join(windows.select("words", "window"), "words").where("item IS NOT NULL").select("window", "item").distinct())
    listed = found.select("row", "window").distinct().join(broadcast_few(of_window), "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = spans.join(listed, "row", "left")
    hit = hit.select(F.col("row").alias(row), covered(F.col("spans")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias(i := unused(source, "_items")), F.array_sort("spans").alias(s := unused(source, "_spans")))
    rows = both.where(F.col(place).isNull()).select(*(F.col(f"`{c}`") for c in kept.columns), row, n_words)
    all_ = rows.join(hit, row, "left")
    ids = F.coalesce(F.col(i), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    extra = [c.alias(name) for c, name in ((F.col(s), spans_col), (ids, items_col)) if name]
    return all_.select(*(F.col(f"`{c}`") for c in kept.columns), n_words, n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *extra)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have windows of the benchmark's items."""
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
m AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS MATERIALIZED (SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM m WHERE len(words) > 0)),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS win FROM p CROSS JOIN (SELECT DISTINCT size FROM w) WHERE i + size - 1 <= len(words)),
f AS MATERIALIZED (SELECT doc_id, i, g.size, item_id FROM g JOIN w ON w.size = g.size AND w.win = g.win),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM f) CROSS JOIN range(10) t(k) WHERE k < size GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
