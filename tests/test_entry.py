"""The driver contract, and each query's rows against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from chronoweave import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v)) for v in row)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, sql, data, name):
    df = entry_module.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(key([r[c] for c in columns]) for r in df.collect())
    found = sql.execute(core.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(key([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_nothing_outside_names_the_training_data_part():
    root = Path(core.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
