import os

import duckdb
import pytest

from verdigris import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_whole_key_difference(spark):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = {r["k"] for r in plans.QUERIES["whole_key_difference"](spark, SF).collect()}
    urgent = {k for (k,) in con.sql("select o_custkey from orders where o_orderpriority = '1-URGENT'").fetchall()}
    wanted = {k for (k,) in con.sql("select c_custkey from customer").fetchall()} - urgent
    assert got == wanted and got and {k for (k,) in con.sql(plans.ORACLES["whole_key_difference"]).fetchall()} == got
