"""Every query with an equivalent gives DuckDB's rows, and the contract's functions fit together."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalog.oracle_sql()[name])
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == columns
    expected = sorted([plain(r[theirs.index(c)]) for c in columns] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == expected
    assert expected


def test_every_query_has_an_equivalent():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_stands_without_the_optional_parts(tmp_path, gone):
    """The package alone is removed, with its tests, or the pipeline too."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    assert not (tmp_path / "repo/ledgerloom/llm").exists() and not (tmp_path / "repo/tests/llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'A3_children_count' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, check=True)
