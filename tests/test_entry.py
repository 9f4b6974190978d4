import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_and_core_sql(spark):
    assert entry.entry(spark).columns
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    from tidewright.plans import registry

    for name, sql in registry.oracles().items():
        df = registry.queries()[name](spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns), name
        key = lambda r: tuple(str(round(x, 5)) if isinstance(x, float) else str(x) for x in r)
        want = sorted(key([r[names.index(c)] for c in df.columns]) for r in cur.fetchall())
        assert sorted(key(r) for r in df.collect()) == want, name
