"""Every registered query against its DuckDB oracle on the smallest tables."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(df: pd.DataFrame, dp: int = 6) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            df[c] = np.round(s.astype(float), dp)
        else:
            df[c] = s.map(lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
    df = df.astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(lambda v: (v is None, str(v)))).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    exp = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    a, b = _norm(got), _norm(exp)
    assert a.equals(b), f"{name}: values differ"


def test_every_query_runs(spark):
    for name, fn in QUERIES.items():
        if name in ORACLES:
            continue
        df = fn(spark, SF_SMALL)
        assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.limit(5).collect()
    assert rows and "Scenario_Score" in df.columns
