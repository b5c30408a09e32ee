from concurrent.futures import ThreadPoolExecutor

import duckdb

import __spark_entry__ as E
from hourglass.plans import catalog
from tests.conftest import SF
from tools.check_oracle import TABLES, digest


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["series", "mse", "n"] and len(rows) == 5


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_every_query_matches_its_sql_at_smoke_scale(spark):
    """All forecasting queries that have SQL; a few run at a time, as each waits for small jobs."""
    sql, queries = E.oracle_sql(), E.queries()
    names = [n for n in catalog.REGISTRY if n in sql]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def rows(name):
        df = queries[name](spark, SF)
        columns = sorted(df.columns)
        return name, columns, [tuple(r) for r in df.select(columns).collect()]

    different = []
    with ThreadPoolExecutor(6) as pool:
        for name, columns, got in pool.map(rows, names):
            con.sql(f"CREATE VIEW oracle_{name} AS {sql[name]}")
            result = con.sql(f"SELECT * FROM oracle_{name}")
            want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM oracle_{name}").fetchall()
            if sorted(result.columns) != columns or digest(columns, got)[0] != digest(columns, want)[0]:
                different.append(name)
    assert not different


def test_queries_without_sql_give_rows(spark):
    sql, queries = E.oracle_sql(), E.queries()
    with ThreadPoolExecutor(4) as pool:
        counts = dict(pool.map(lambda n: (n, queries[n](spark, SF).count()), [n for n in catalog.REGISTRY if n not in sql]))
    assert all(counts.values()), counts
