"""Exports of several tables as one: the manifest is the commit, so readers see all of them or none.

The rows lie in a folder of their own that nobody knows of until the manifest names it. The
manifest is one small file that is written last and never replaced; no folder is renamed, so the
export is also whole on object stores, where a rename is a copy. An export of the same content is
found and left as it is; one of other content is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.sources.tables import content_digest, hadoop_path, write_ndjson

MANIFEST = "manifest.json"


class ExportError(ValueError):
    """An export can't be made or read."""


def manifest_of(spark: SparkSession, folder: str) -> dict | None:
    path, files = hadoop_path(spark, f"{folder}/{MANIFEST}")
    if not files.exists(path):
        return None
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/{MANIFEST}").collect())  # one line
    return json.loads(text)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file unless it is there; false if it is."""
    target, files = hadoop_path(spark, path)
    try:
        out = files.create(target, False)
    except Exception as raised:  # the file system's own error for a file that is there
        if files.exists(target):
            return False
        raise raised
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def export_tables(tables: dict[str, tuple[DataFrame, str]], folder: str) -> DataFrame:
    """(name, rows, sha256, replayed) of each table; ``tables`` has rows and the key that orders them by name."""
    spark = next(iter(tables.values()))[0].sparkSession
    digests = {name: tuple(content_digest(rows).first()) for name, (rows, _) in tables.items()}
    known = manifest_of(spark, folder)
    if known is None:
        data = f"data-{uuid.uuid4().hex}"
        for name, (rows, key) in tables.items():
            write_ndjson(rows, f"{folder}/{data}/{name}", key)
        made = json.dumps({"data": data, "tables": {name: {"rows": n, "sha256": h} for name, (n, h) in digests.items()}})
        replayed = not put_once(spark, f"{folder}/{MANIFEST}", made + "\n")
        if replayed:  # another export came first: this one's rows go
            path, files = hadoop_path(spark, f"{folder}/{data}")
            files.delete(path, True)
            known = manifest_of(spark, folder)
    else:
        replayed = True
    if known is not None and {n: (t["rows"], t["sha256"]) for n, t in known["tables"].items()} != digests:
        raise ExportError(f"{folder} has another export")
    return spark.createDataFrame([(name, n, h, replayed) for name, (n, h) in digests.items()], "name string, rows long, sha256 string, replayed boolean")


def read_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table of an export; an error if there is no whole export."""
    known = manifest_of(spark, folder)
    if known is None or name not in known["tables"]:
        raise ExportError(f"{folder} has no export of {name}")
    return spark.read.schema(schema).json(f"{folder}/{known['data']}/{name}")


def verified(spark: SparkSession, folder: str, schemas: dict) -> DataFrame:
    """(name, intact): whether each table has the rows that the manifest tells of."""
    known = manifest_of(spark, folder) or {"tables": {}}
    rows = []
    for name, schema in schemas.items():
        n, digest = content_digest(read_table(spark, folder, name, schema)).first()
        rows.append((name, {"rows": n, "sha256": digest} == known["tables"].get(name)))
    return spark.createDataFrame(rows, "name string, intact boolean").select("name", F.col("intact"))
