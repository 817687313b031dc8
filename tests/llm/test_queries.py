"""The queries of this package against their SQL."""
import math
import os
from collections import Counter

import duckdb
import pytest

from graindeck.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    return v if isinstance(v, bool) or not isinstance(v, (int, float)) else "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(Q.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert Counter(tuple(plain(x[c]) for c in cols) for x in df.collect()) == Counter(tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall())
