"""Registered queries: the same rows as their SQL, or rows at all."""

from __future__ import annotations

import os

import pytest

from loanline.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
