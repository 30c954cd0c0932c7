"""Every registered query of the reference's operators against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from lodestone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert rows or name == "bottlenecks"
        return
    found = duck.execute(catalogue.oracle_sql()[name])
    kinds = {x[0]: str(x[1]) for x in found.description}
    assert sorted(kinds) == cols and {c: KINDS[k] for c, k in df.dtypes} == kinds
    at = [list(kinds).index(c) for c in cols]
    assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
