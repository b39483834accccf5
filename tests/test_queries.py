"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from costloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def shown(rows):
    def f(v):
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    return sorted([tuple(map(f, r)) for r in rows], key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert len(got) == len(want) > 0
    a, b = shown(got), shown([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want])
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, (int, float)) and p == pytest.approx(q, abs=2e-5)) for p, q in zip(x, y)), (x, y)


def test_entry_reads_whole_tables():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
