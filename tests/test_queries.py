"""Every query of the matching engine on the smallest tables: against SQL where there is some, else for rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from weft.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(x):
    if isinstance(x, (float, np.floating)):
        return "none" if np.isnan(x) else round(float(x), 6) + 0.0
    return x if isinstance(x, bool) else int(x) if isinstance(x, (int, np.integer)) else "none" if x is None else str(x)


def canonical(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    if name in registry.ORACLES:
        want = sql.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got) > 0
