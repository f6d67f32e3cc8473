import sys

import duckdb
import pytest

import __spark_entry__ as E
from cartlytics.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def test_all_are_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted([*(f"op{k}" for k in range(1, 14)), "pipeline"])


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert [str(t).replace("VARCHAR", "string").replace("INTEGER", "int").lower() for t in want.types] == [got.schema[c].dataType.simpleString() for c in want.columns]


def test_entry_does_without_this_subpackage():
    """With the subpackage not importable, the entry still has all other queries."""
    import subprocess

    code = ("import sys; sys.modules['cartlytics.llm'] = None; import __spark_entry__ as E; "
            "assert len(E.queries()) > 40 and not [n for n in E.queries() if n.startswith('op') and n[2].isdigit()]")
    assert subprocess.run([sys.executable, "-c", code], cwd=E.os.path.dirname(E.__file__), check=False).returncode == 0
