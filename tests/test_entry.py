"""The entry module: with and without the optional parts, and its SQL against DuckDB."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "meterline", tmp_path / "meterline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'level_table' in q and not any(n.startswith('op') for n in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def comparable(rows):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return round(float(v), 4) + 0.0
        return str(v)

    return sorted(([one(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith("op")])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(df.columns)
    sql = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in sql.description].index(n) for n in names]
    assert comparable(df.select(*[f"`{n}`" for n in names]).collect()) == comparable([[r[i] for i in at] for r in sql.fetchall()])
