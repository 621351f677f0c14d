"""Every registered query with oracle SQL agrees with DuckDB on sf0.001; the rest run."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tools.oracle_check import TABLES, canon

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
TRAINING = {k for k in QUERIES if k not in ORACLES}
FAMILY = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "double": "float",
          "float": "float", "string": "str", "varchar": "str"}


def _family(t: str) -> str:
    return FAMILY.get(t, t)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "f1_macro" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    orows = cur.fetchall()
    c1, r1 = canon(df.columns, rows)
    c2, r2 = canon([d[0] for d in cur.description], orows)
    assert c1 == c2
    assert r1 == r2
    # same type family per column (no DECIMAL on the SQL side, ints vs ints, ...)
    duck = {r[0]: r[1].lower() for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    for f in df.schema.fields:
        assert _family(f.dataType.simpleString()) == _family(duck[f.name]), (f.name, f.dataType, duck[f.name])


@pytest.mark.parametrize("name", sorted(k for k in TRAINING if not k.startswith(("h9", "h11", "d12"))))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() > 0
