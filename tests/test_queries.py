"""Every registered query of the regression engine against its SQL form in DuckDB, or for its rows."""

import duckdb
import pytest

import __spark_entry__
from cdfloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def normal(rows):
    return sorted((tuple(round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert normal(got) == normal(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True, timeout=120)


@pytest.mark.parametrize("gone", [["cdfloom/llm", "tests/llm"], ["cdfloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    """Both registries work in a copy that lacks the subpackage, the pipeline, or both."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache", *[os.path.basename(g) for g in gone]))
    for g in gone:
        assert not (copy / g).exists()
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(sorted(n for n in q if n == 'pipeline' or n.startswith('op1')))"
    said = subprocess.run([sys.executable, "-B", "-c", code], check=True, timeout=120, cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True).stdout
    there = gone == ["corpus_pipeline.py"] and os.path.isdir(f"{root}/cdfloom/llm")
    assert said.strip() == ("['op10_quality_rules', 'op1_html_extraction']" if there else "[]")
