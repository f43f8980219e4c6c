"""Every query of the library against its SQL in DuckDB, over the smallest tables; the rest has to give rows."""

import math
import os

import duckdb
import pytest
from plumbline import plans, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    """Numbers to six significant digits, whatever their type."""
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(f) else float(f"{f:.6g}") + 0.0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((repr(tuple(plain(row[names.index(c)]) for c in cols)) for row in r.fetchall()))
    assert sorted(repr(tuple(plain(row[c]) for c in cols)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_llm_folder(tmp_path):
    """The driver deletes the subpackage and its pipeline: the rest has to import and to have its queries."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{here}/plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL)), "False"]
