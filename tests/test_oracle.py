"""Every query of the library's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from convlog.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        return f"{float(x):.9g}" if not isinstance(x, str) and hasattr(x, "__float__") else str(x)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.SQL:
        assert len(got) > 0
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(got) == rows(db.execute(catalog.SQL[name]).df())


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
