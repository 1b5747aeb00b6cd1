"""Exports of two tables as one."""

from __future__ import annotations

import pytest

from lexiforge.sources.pairs import ExportError, export_tables, manifest_of, put_once, read_table, verified

SCHEMAS = {"a": "id long, t string", "b": "id long, n long"}


def pair(spark, n=20):
    return {"a": (spark.range(n).selectExpr("id", "concat('t', id) AS t"), "id"), "b": (spark.range(n).selectExpr("id", "id * 2 AS n"), "id")}


def test_readers_see_both_or_none(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/export"
    with pytest.raises(ExportError):
        read_table(spark, folder, "a", SCHEMAS["a"])
    monkeypatch.setattr("lexiforge.sources.pairs.put_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        export_tables(pair(spark), folder)
    with pytest.raises(ExportError):  # the rows are there, the manifest isn't
        read_table(spark, folder, "a", SCHEMAS["a"])
    monkeypatch.undo()
    assert not export_tables(pair(spark), folder).where("replayed").count()
    assert read_table(spark, folder, "a", SCHEMAS["a"]).count() == read_table(spark, folder, "b", SCHEMAS["b"]).count() == 20


def test_replay_and_other_content(spark, tmp_path):
    folder = f"{tmp_path}/export"
    export_tables(pair(spark), folder)
    data = manifest_of(spark, folder)["data"]
    again = export_tables({n: (rows.repartition(4), key) for n, (rows, key) in pair(spark).items()}, folder)
    assert again.where("replayed").count() == 2 and manifest_of(spark, folder)["data"] == data
    with pytest.raises(ExportError):
        export_tables(pair(spark, 21), folder)
    assert all(r.intact for r in verified(spark, folder, SCHEMAS).collect())
    spark.range(1).selectExpr("id", "'x' AS t").write.mode("append").json(f"{folder}/{data}/a")
    assert {r.name: r.intact for r in verified(spark, folder, SCHEMAS).collect()} == {"a": False, "b": True}


def test_the_manifest_is_never_replaced(spark, tmp_path):
    assert put_once(spark, f"{tmp_path}/m", "1") and not put_once(spark, f"{tmp_path}/m", "2")
    assert open(f"{tmp_path}/m", encoding="utf-8").read() == "1"
