import os

import duckdb
import pytest

import __spark_entry__ as entry
from verdigris import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["auroc_by_condition", "shared_negatives_by_generator", "slice_report", "candidate_key_join", "rule_scan", "hamming_join"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "part", "customer", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = plans.QUERIES[name](spark, SF).toPandas()
    wanted = con.sql(plans.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    text = lambda d: sorted(d[columns].map(lambda x: "" if x is None or x != x else f"{x:.8g}" if isinstance(x, float) else str(x)).agg("|".join, axis=1))
    assert text(got) == text(wanted)
