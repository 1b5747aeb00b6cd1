"""A bucket of shingles is told apart in little more memory than its shingles take."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from lexiforge.llm import jaccard_join as J


class Grouped:
    """Stands for the blobs' table and keeps the function of its groups."""

    def repartition(self, *_):
        return self

    groupBy = repartition  # noqa: N815

    def applyInArrow(self, function, _):  # noqa: N802
        self.function = function
        return self


def test_memory_of_a_bucket():
    rng = np.random.default_rng(7)
    shared, common = np.arange(5, 40_005, dtype=np.uint64), np.array([1, 2], np.uint64)
    blobs = []
    for i in range(200):
        ids = np.concatenate((rng.integers(1 << 20, 1 << 48, 2000).astype(np.uint64), shared[i * 100 : i * 100 + 300], common[: i % 3]))
        blobs.append({"bucket": 0} | J.blob(np.sort(i * 10**6 + np.arange(len(ids)) // 3), np.full(len(ids), 500, np.uint32), ids))
    rows = pa.Table.from_pylist(blobs, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "runs", "ids"))]))
    keep = J.shared_shingles(Grouped(), 1, 4, common).function
    tracemalloc.start()
    found = keep((pa.scalar(0),), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * 200 * 2300
    _, _, ids = J.unblob(found)
    assert set(ids.tolist()) == set(shared[100:20_100].tolist()) | set(common.tolist()) and (np.diff(found["group"].to_numpy()) > 0).all()
