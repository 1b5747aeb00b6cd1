"""A log as a Spark sink: lines of JSON in files of bounded size, committed by batch.

Each task writes files of its own and begins another before one would exceed the bound. Files
count only once the batch's manifest names them, which is written last and in one step: readers
see a batch whole or not at all. A task that fails removes what it wrote, a job that is aborted
removes what its tasks wrote, and a batch that is committed already is not taken again, so a
replay writes nothing twice. What a killed task or a lost executor leaves is in no manifest, so
it is never read; ``sweep`` removes it. A line beyond the bound fails the task. Of old batches as
many are kept as asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lexiforge.sources import files

COMMITS = "_commits"


@dataclass
class Written(WriterCommitMessage):
    #: (name, lines, bytes)
    files: list[tuple[str, int, int]] = field(default_factory=list)


class LogFiles:
    """What the writers of batches and of streams share."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.retained = options["path"], int(options.get("bytes", str(64 << 20))), int(options.get("retained", "0"))
        #: Of this job, in the names of all its files.
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = files.opened(self.path)
        store.create_dir(folder, recursive=True)
        task, done, out, name, lines, size = TaskContext.get(), Written(), None, "", 0, 0

        def closed() -> None:
            if out is not None:
                out.close()
                done.files.append((name, lines, size))

        try:
            for row in rows:
                line = (json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str, separators=(",", ":")) + "\n").encode("utf-8")
                if len(line) > self.most:
                    raise ValueError(f"a line has {len(line)} bytes, more than {self.most}")
                if out is None or size + len(line) > self.most:
                    closed()
                    name, lines, size = f"events.{self.job}.{task.partitionId():05d}.{task.taskAttemptId()}.{len(done.files):05d}.jsonl", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}")
                out.write(line)
                lines, size = lines + 1, size + len(line)
            closed()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            self.remove([*(f[0] for f in done.files), *([name] if name else [])])
            raise
        return done

    def remove(self, names: list[str]) -> None:
        store, folder = files.opened(self.path)
        for name in {*names}:
            if store.get_file_info(f"{folder}/{name}").is_file:
                store.delete_file(f"{folder}/{name}")

    def settled(self, messages: list[Written | None], batch: str) -> None:
        """Commits the batch, unless it is committed already: then its files go again."""
        store, folder = files.opened(self.path)
        own = [f for m in messages if m is not None for f in m.files]
        store.create_dir(f"{folder}/{COMMITS}", recursive=True)
        manifest = f"{folder}/{COMMITS}/{batch}.json"
        if store.get_file_info(manifest).is_file:
            self.remove([f[0] for f in own])
            return
        files.put(store, manifest, "".join(json.dumps({"batch": batch, "file": n, "lines": lines, "bytes": size}) + "\n" for n, lines, size in own))
        if self.retained:
            manifests = files.listed(store, f"{folder}/{COMMITS}")
            for old in manifests[: -self.retained]:
                self.remove([json.loads(line)["file"] for line in files.read(store, old).splitlines()])
                store.delete_file(old)

    def undone(self) -> None:
        """Removes all files of the job, those of tasks that have sent no message too."""
        store, folder = files.opened(self.path)
        self.remove([f.rsplit("/", 1)[-1] for f in files.listed(store, folder) if f"/events.{self.job}." in f])


class BatchWriter(LogFiles, DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.batch = options.get("batch") or uuid.uuid4().hex

    def commit(self, messages: list[Written | None]) -> None:
        self.settled(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self.undone()


class StreamWriter(LogFiles, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.settled(messages, f"{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.undone()


class RotatedLog(DataSource):
    """Options: path; bytes, the bound of a file; retained, the batches that are kept (0: all); batch, the name of a batch that may be replayed."""

    @classmethod
    def name(cls) -> str:
        return "rotated_log"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return StreamWriter(self.options)


def append_log(rows: DataFrame, path: str, batch: str, most: int, retained: int = 0) -> None:
    """Appends ``rows`` as one batch; nothing happens if a batch of that name is there."""
    rows.sparkSession.dataSource.register(RotatedLog)
    rows.write.format("rotated_log").mode("append").option("bytes", most).option("batch", batch).option("retained", retained).save(path)


def sweep(spark: SparkSession, path: str, seconds: float = 86_400) -> int:
    """Removes files that no manifest names and that are older than any running job; how many there were."""
    store, folder = files.opened(path)
    before = datetime.now(timezone.utc) - timedelta(seconds=seconds)
    lines = spark.read.text(path, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_name").alias("file")).distinct()
    orphans = lines.join(committed(spark, path).select("file"), "file", "left_anti")
    swept = 0
    for row in orphans.toLocalIterator():  # what killed tasks have left since the last sweep
        info = store.get_file_info(f"{folder}/{row.file}")
        if info.is_file and info.mtime <= before:
            store.delete_file(info.path)
            swept += 1
    return swept


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, file, lines, bytes) of all committed files."""
    return spark.read.schema("batch string, file string, lines long, bytes long").json(f"{path}/{COMMITS}")


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of committed files."""
    lines = spark.read.text(path, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_name").alias("file"))
    return lines.join(committed(spark, path).select("file"), "file", "left_semi").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
