"""The queries that SQL can express agree with their SQL."""

from __future__ import annotations

import pytest

from conftest import against_sql
from lexiforge.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck, sf_dir):
    against_sql(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
