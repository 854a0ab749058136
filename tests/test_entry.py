from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from mathloom.plans import catalog, storage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 123


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def rows(names, found):
    def plain(v):
        return None if v is None or v != v else round(v, 5) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "part", "nation"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_other_queries_stay_when_a_module_is_missing():
    """With zstandard not to be imported, the corpus operators are left out and the rest works."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), 'op5_secrets' in e.queries())"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert got.stdout.split() == [str(len(catalog.QUERIES)), "False"] and got.stderr


def test_no_folder_of_its_own_on_a_cluster():
    from unittest.mock import MagicMock

    session = MagicMock()
    session.sparkContext.master = "spark://host:7077"
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    session.sparkContext.getConf().get.return_value = None
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(session)
