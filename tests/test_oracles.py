"""Every query with SQL gives the same rows as that SQL."""

import os

import pytest

from tests.compare import connect, difference
from tickerloom.functions.text import english_stop_words
from tickerloom.plans import oracles
from tickerloom.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracles.build()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_stop_words_are_the_public_list(spark):
    assert sorted(oracles.STOP_WORDS) == sorted(english_stop_words(spark))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, FOLDER, name, SQL[name]) == ""
