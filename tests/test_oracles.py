"""Every query of the reference's own operators runs, and agrees with its SQL where it has one."""

from __future__ import annotations

import pytest

from conftest import against_sql
from lexiforge.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        against_sql(df, duck, ORACLES[name])
    else:
        assert df.count() >= 0 and df.columns


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
