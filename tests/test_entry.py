"""The driver contract: names, guards, and SQL twins on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from assaykit.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return str(v)[:19].replace("T", " ").replace(" 00:00:00", "") if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_twin(spark, sf_dir, db, name):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda df: sorted(([plain(v) for v in r] for r in df[names].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_language_model_folders(tmp_path):
    import shutil

    shutil.copytree(ROOT / "assaykit", tmp_path / "assaykit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert said.stdout.split() == [str(len(catalogue.queries())), "False"], said.stderr
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-p", "no:cacheprovider", "-k", "cues or every_other_query or hold_their_mean"], cwd=tmp_path, capture_output=True, text=True)
    assert "3 passed" in run.stdout, run.stdout[-2000:]
