"""The registry works with and without the removable parts, and queries agree with their SQL on the smallest tables."""

import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT, DATA = Path(entry.__file__).parent, "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
#: Every query that has SQL; the SQL of the driver, and no other.
COMPARED = sorted(entry.oracle_sql())


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())


@needs_data
@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, DATA), con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    shown = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(got.select(*columns).collect()) == shown(want.fetchall())


def test_the_rest_stands_without_the_removable_parts(tmp_path):
    shutil.copytree(ROOT / "tablesense", tmp_path / "tablesense", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_a_broken_part_is_not_passed_over(tmp_path):
    shutil.copytree(ROOT / "tablesense", tmp_path / "tablesense", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tablesense" / "llm").mkdir()
    (tmp_path / "tablesense" / "llm" / "__init__.py").touch()
    (tmp_path / "tablesense" / "llm" / "queries.py").write_text("import surely_not_installed")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, check=False, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode and "surely_not_installed" in done.stderr
    assert importlib.util.find_spec("surely_not_installed") is None
