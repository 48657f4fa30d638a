"""Every query with SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, db, name, tmp_path):
    out = str(tmp_path / "out")
    registry.QUERIES[name](spark, SF).write.parquet(out)
    db.execute(f"CREATE OR REPLACE VIEW got AS SELECT * FROM '{out}/*.parquet'")
    db.execute(f"CREATE OR REPLACE TABLE want AS {registry.ORACLES[name]}")
    told = lambda t: sorted((r[0], r[1]) for r in db.execute(f"DESCRIBE {t}").fetchall())
    assert told("got") == told("want")
    columns = ", ".join(f'"{c}"' for c, _ in told("got"))
    for a, b in (("got", "want"), ("want", "got")):
        assert db.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []
