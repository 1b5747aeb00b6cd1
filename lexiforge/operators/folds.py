"""Folds of ordered rows by key, where each step depends on the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict | None]], schema: str) -> DataFrame:
    """What ``step`` gives for each row of ``rows``, in ``order`` within ``key``; (key, then the columns of ``schema``).

    ``step(state, row)`` returns the next state and a row, or None. Rows are dealt out by
    key and sorted there by Spark, which spills; a task holds one state and one batch, so
    a key may have any number of rows. Keys are not null.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row[key] != at:
                    at, state = row[key], start()
                state, made = step(state, row)
                if made is not None:
                    out.append({key: at} | made)
            yield pa.RecordBatch.from_pylist(out, arrow_schema)

    of_key = next(f for f in rows.schema.fields if f.name == key)
    empty = rows.sparkSession.createDataFrame([], f"`{key}` {of_key.dataType.simpleString()}, {schema}")
    arrow_schema = empty.toArrow().schema
    return rows.where(rows[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInArrow(folded, empty.schema)
