"""Shapes that must hold for every result of the llm queries on the smallest tables."""

import os

import pytest

from lodesift.llm import queries
from lodesift.sources.tables import table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_containers_hold_every_token(spark):
    from lodesift.llm.tokens import with_tokens

    total = with_tokens(table(spark, FOLDER, "documents"), ["doc_id"], "text").groupBy().sum("tokens").first()[0]
    for r in queries.p7_report(spark, FOLDER).collect():
        assert r["tokens"] == total and r["filled"] <= 1


def test_shares(spark):
    for r in queries.p8_shares(spark, FOLDER).collect():
        assert r["most_copies"] <= r["max_repeats"]


def test_groups_cover_pairs(spark):
    groups = {r["record_id"]: r["group_id"] for r in queries.p3_groups(spark, FOLDER).collect()}
    for r in queries.p3_found(spark, FOLDER).collect():
        assert groups[r["record_a"]] == groups[r["record_b"]]
