import math
import os

import duckdb
import pytest

import palimpsest.plans.detection  # noqa: F401  (registers its queries)
import palimpsest.plans.names  # noqa: F401
import palimpsest.plans.release  # noqa: F401
from palimpsest.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(columns, data):
    order = sorted(columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return order, sorted((tuple(clean(r[columns.index(c)]) for c in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, [tuple(float(v) if v.__class__.__name__ == "Decimal" else v for v in r) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
