"""Queries over keys as large as those of tables many times the given ones, against their own SQL."""

import duckdb

import __spark_entry__ as entry


def against_sql(spark, folder, name, table, ddl):
    con = duckdb.connect()
    con.execute(f"create table {table} as {ddl}")
    con.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    return sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()), sorted(want)


def test_numbers_of_keys_beyond_twelve_digits(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "q_make_number", "orders", "select unnest([0, 7, 6684299, 6684300, 8999999])::bigint as o_orderkey")
    assert got == want and {len(n) for _, n in got} == {13, 14}


def test_keys_that_draw_the_same_are_as_the_sql_has_them(spark, tmp_path):
    """Of a million customers' keys two draw one number, and these two one name."""
    con = duckdb.connect()
    con.execute("create table customer as select unnest([284396, 447983, 22219, 659624, 5])::bigint as c_custkey")
    con.execute("create table supplier as select unnest([1, 2])::bigint as s_suppkey")
    con.execute("create table orders as select 0::bigint as o_orderkey, 5::bigint as o_custkey, timestamp '1995-02-03' as o_orderdate")
    con.execute("create table lineitem as select 0::bigint as l_orderkey, 1 as l_linenumber, 1::bigint as l_partkey, 1::bigint as l_suppkey, 10.0 as l_extendedprice, 1.0 as l_quantity, 'R' as l_returnflag")
    for t in ("customer", "supplier", "orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    for name in ("q_mint_numbers", "q_issuers", "q_generated_registry", "q_generated_overlap"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
    assert entry.queries()["q_mint_numbers"](spark, str(tmp_path)).select("reg_no").distinct().count() == 4
