"""Queries on segments work on a document's or a line's row where it lies, in memory that its bytes tell."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest

from lexiforge.operators.html import segment_lists
from lexiforge.plans import QUERIES


@pytest.mark.parametrize(("name", "exchanges"), [("script_segments", 0), ("gloss_gaps", 0), ("gloss_coverage", 1)])
def test_segments_are_not_shuffled(name, exchanges, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == exchanges


def test_memory_of_segments():
    texts = pa.array([" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(300)] + [None, ""])
    tracemalloc.start()
    found = segment_lists(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000  # as Python's strings they take more than 60 MB
    assert ["".join(x) for x in found.to_pylist()] == [t or "" for t in texts.to_pylist()]
