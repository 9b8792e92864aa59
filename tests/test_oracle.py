"""Every registered query of the sales model against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from receivia.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    if v is None or pd.isna(v):
        return "~"
    try:
        return repr(float(v)) if not isinstance(v, (bool, str)) and not hasattr(v, "isoformat") else str(v).removesuffix(" 00:00:00")
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
