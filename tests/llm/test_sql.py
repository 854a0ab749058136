from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from mathloom.llm import jaccard, queries, sharding, sql
from tests.llm.fixtures import documents, odd
from tests.llm.test_pairs import family


@pytest.fixture(scope="module")
def rows(spark, sf):
    """Odd rows with one row for each doc_id."""
    return list({r[0]: r for r in odd(spark, sf, family()) if r[0] is not None}.values())


@pytest.fixture(scope="module")
def con(rows):
    made = duckdb.connect()
    made.sql("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    made.executemany("insert into documents values (?, ?, ?, ?)", rows)
    return made


def test_join_against_sql(spark, rows, con):
    got = jaccard.near_duplicates(documents(spark, rows))
    want = con.sql(f"select {', '.join(got.columns)} from ({sql.oracle_sql()['op7_ngram_jaccard_join']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_sharding_against_sql(spark, rows, con):
    got = sharding.sharded(documents(spark, rows))
    want = con.sql(f"select {', '.join(got.columns)} from ({sql.oracle_sql()['op10_sharding']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())
