"""Every registered query against its SQL at the smallest scale, and the package without its llm part."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from framelake import registry_more  # noqa: F401
from framelake.registry import ORACLES, QUERIES
from tests.conftest import SF

ROOT = Path(__file__).resolve().parents[1]


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("null" if r[k] is None else repr(round(float(r[k]), 5) + 0.0) if isinstance(r[k], int | float) else str(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cursor = tables.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(cursor.fetchall(), columns)


def test_package_stands_without_llm(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('framelake.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'confirmed_users' in e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
