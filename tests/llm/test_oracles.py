"""Registered queries against their oracle SQL in DuckDB."""

import pytest

from batchlens.llm import queries

from .cases import key


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    from tests.conftest import SF_SMALL

    found = queries.QUERIES[name](spark, SF_SMALL)
    names = sorted(found.columns)
    want = duck.execute(queries.ORACLES[name])
    order = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=key)
    assert sorted((tuple(r) for r in found.select(names).collect()), key=key) == rows
