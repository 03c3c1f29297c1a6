"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob

import pytest

from attesta.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {f.split('/')[-1].removesuffix('.parquet')} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    cols = sorted(df.columns)
    found = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert found == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())


def test_entry_stands_without_the_subpackage(tmp_path):
    """The entry imports, and its queries are there, when the subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/attesta", f"{tmp_path}/attesta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
