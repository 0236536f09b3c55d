"""Registered queries against their checking SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from saldoscope.sources.book import TABLES

SF = "/root/testdata/sf0.001"
SOME = ["account_profile", "velocity_bursts_from_six_rows", "recurring_rows", "layering", "carding", "consecutive_rounds", "bm25", "map_rows_card", "rate_limit", "serial_numbers"]


def plain(rows):
    return sorted(repr([None if v is None or v != v else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_checking_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, df.select(*[f"`{c}`" for c in cols]).collect())) == plain(want)


def test_every_checked_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
