import math

import duckdb

from brindle.plans import core

SF = "/root/testdata/sf0.001"


def test_pricing_summary_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    rows = con.sql(core.PRICING_SUMMARY)
    mine = core.pricing_summary(spark, SF).select(*rows.columns).collect()
    theirs = rows.fetchall()
    assert len(mine) == len(theirs) > 0
    for a, b in zip(sorted(map(tuple, mine)), sorted(theirs), strict=True):
        assert a[:2] == b[:2] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[2:], b[2:], strict=True))
