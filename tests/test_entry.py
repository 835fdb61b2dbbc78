import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_check_digit", "q_expected_tax", "q_tax_errors", "q_registry_build", "q_registry_status", "q_json_salvage"])
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted(want, key=key)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
