"""The driver contract: queries agree with their SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from junctura.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cursor = con.cursor().execute(catalog.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalog.QUERIES) <= set(contract.queries())


def test_graph_queries_stand_alone():
    code = "import sys; sys.modules['xxhash'] = None; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 30"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
