"""Feeds that are followed by cursor, and logs that roll by size and commit by batch."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lexiforge.sources.feeds import merged, read_feeds, write_feed
from lexiforge.sources.logs import RotatedLog, append_log, committed, read_log, sweep

FEED = "feed string, cursor string, next string, position int, href string, title string"


@pytest.fixture
def feeds(spark, tmp_path):
    rows = [
        ("a", "first", "p2", 0, "/x", "12"), ("a", "first", "p2", 1, "/y", "Y"), ("a", "p2", "p3", 0, "/x", "X"), ("a", "p3", None, 0, "/z", "Z"), ("a", "p3", None, 1, "/x", "Other"),
        ("b", "first", "q", 0, "/b", "B"), ("b", "q", "first", 0, "/c", "٣"), ("lost", "first", "gone", 0, "/l", "L"),
    ]
    write_feed(spark.createDataFrame(rows, FEED), f"{tmp_path}/feeds")
    return f"{tmp_path}/feeds"


def test_cursors_are_followed_and_targets_merged(spark, feeds):
    items = read_feeds(spark, feeds, ["a", "b"])
    assert items.count() == 7 and items.rdd.getNumPartitions() == 2
    assert {tuple(r) for r in merged(items).collect()} == {("a", "/x", "X", 2, True), ("a", "/y", "Y", 0, False), ("a", "/z", "Z", 0, False), ("b", "/b", "B", 0, False), ("b", "/c", "٣", 0, False)}


def test_a_known_cursor_stops_the_feed(spark, feeds):
    assert {r.href for r in read_feeds(spark, feeds, ["a"], {"a": "p3"}).collect()} == {"/x", "/y"}
    assert read_feeds(spark, feeds, ["a"], {"a": "first"}).count() == 0
    assert read_feeds(spark, feeds, []).count() == 0


def test_feeds_that_cannot_be_read_whole_are_errors(spark, feeds):
    for options in ({"feeds": ["lost"]}, {"feeds": ["a"], "pages": 2}):
        with pytest.raises(Exception, match="no page gone|more than 2 pages"):
            read_feeds(spark, feeds, **options).collect()


def test_pages_from_a_function(spark):
    def fetch(feed, cursor):
        n = 0 if cursor == "first" else int(cursor)
        return {"items": [{"href": f"/{feed}/{n}"}], "next": str(n + 1) if n < 4 else None}

    assert read_feeds(spark, "", ["u", "v"], fetch=fetch).count() == 10


def names(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".jsonl"))


def test_files_roll_and_batches_commit_once(spark, tmp_path):
    path, rows = f"{tmp_path}/log", spark.range(0, 1000, numPartitions=3).select("id", F.concat(F.lit("é line "), F.col("id").cast("string")).alias("text"))
    append_log(rows, path, "one", 4096)
    first = names(path)
    assert len(first) > 3 and all(os.path.getsize(f"{path}/{f}") <= 4096 for f in first)
    append_log(rows, path, "one", 4096)
    assert names(path) == first
    append_log(rows.where("id < 10"), path, "two", 4096)
    assert sorted(r.id for r in read_log(spark, path, rows.schema).collect()) == sorted([*range(1000), *range(10)])
    assert committed(spark, path).agg(F.sum("lines"), F.max("bytes")).first()[0] == 1010
    append_log(rows.where("id < 5"), path, "zoo", 4096, retained=1)
    assert sorted(r.id for r in read_log(spark, path, rows.schema).collect()) == [0, 1, 2, 3, 4] and len(names(path)) <= 3


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = f"{tmp_path}/log"
    append_log(spark.range(3), path, "good", 1000)
    before = names(path)
    failing = spark.range(0, 300, numPartitions=3).select(F.when(F.col("id") == 299, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        append_log(failing, path, "bad", 200)
    assert read_log(spark, path, "id long").count() == 3
    time.sleep(1)  # tasks beside the failed one are killed, and may have left files that no manifest names
    sweep(spark, path, 0)
    assert names(path) == before and committed(spark, path).select("batch").distinct().count() == 1
    with pytest.raises(Exception, match="more than 50"):
        append_log(spark.range(1).select(F.repeat(F.lit("x"), 60).alias("t")), path, "long", 50)
    assert names(path) == before


def test_a_stream_that_is_started_again_writes_nothing_twice(spark, tmp_path):
    spark.dataSource.register(RotatedLog)
    source, path = f"{tmp_path}/in", f"{tmp_path}/log"
    spark.range(0, 50, numPartitions=1).write.parquet(source)

    def run(offsets):
        stream = spark.readStream.schema("id long").parquet(source)
        stream.writeStream.format("rotated_log").option("bytes", 100).option("path", path).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()

    run(f"{tmp_path}/offsets")
    run(f"{tmp_path}/offsets")
    before = names(path)
    run(f"{tmp_path}/lost-offsets")  # the same batch again
    assert names(path) == before and sorted(r.id for r in read_log(spark, path, "id long").collect()) == list(range(50))
    assert json.loads(open(f"{path}/{before[0]}", encoding="utf-8").readline())["id"] == 0
