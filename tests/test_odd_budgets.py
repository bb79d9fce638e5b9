"""Budgets that small tables do not have: a deficit, and made-up figures that happen to be grounded."""

import duckdb
import pytest

from ledgerloom.plans import registry


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    con = duckdb.connect()
    con.execute(f"copy (select unnest([8648, 8649, 8650, 4250, 6550, 13250, 4251]) as c_custkey) to '{at}/customer.parquet'")
    con.execute(f"copy (select 8648 + r as conv_id, t as turn, 'user' as role, 'Hello there.' as text from range(3) x(r), range(2) y(t)) to '{at}/conversations.parquet'")
    con.execute(f"copy (select r as p_partkey, 'old bolt' as p_name from range(40) x(r)) to '{at}/part.parquet'")
    for name in ("customer", "conversations", "part"):
        con.execute(f"create view {name} as select * from '{at}/{name}.parquet'")
    return at, con


@pytest.mark.parametrize("name, told", [("chat_turns", {8648: 1, 8649: 0, 8650: 1}), ("refined_replies", {4250: 1, 4251: 0, 6550: 1, 13250: 1, 8648: 1, 8649: 2, 8650: 3})])
def test_query_equals_sql_on_odd_budgets(spark, odd, name, told):
    at, con = odd
    df = registry.queries()[name](spark, at)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall())
    assert {r[0]: r[1] for r in got} == told
