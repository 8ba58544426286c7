"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import importlib.util
import os

import pytest
from compare import connect, difference
from conftest import FOLDER

from tallyframe.checks import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


ENTRY = _entry_module()
# the reports; training-text queries, where present, have tests of their own
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    with connect(FOLDER) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(built, duck, name):
    assert difference(built(name), duck, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(ENTRY.queries()) and set(SQL) <= set(ENTRY.oracle_sql())


def test_flagship_query_has_rows(spark):
    assert ENTRY.entry(spark).count() > 0
