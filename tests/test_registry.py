import os
import subprocess
import sys
from collections import Counter

import __spark_entry__
import duckdb
import pytest
from fsaudit.plans import registry

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(want.project(", ".join(cols)).fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r.size for r in rows] == sorted((r.size for r in rows), reverse=True)


def test_the_rest_works_without_the_subpackage(tmp_path):
    """As if it were deleted: the entry imports and registers the other queries."""
    for name in ("__spark_entry__.py", "fsaudit"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for x in os.listdir(os.path.join(ROOT, "fsaudit")):
        if x not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "fsaudit", x), tmp_path / "fsaudit" / x)
    code = f"import sys; sys.path = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ('', {ROOT!r})]; import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.stdout.split() == [str(len(registry.queries())), "[]"], out.stderr
