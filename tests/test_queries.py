"""A sample of registered queries against their SQL on the smallest tables."""

import pytest

from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "tokenize_documents", "tokenize_entity_texts", "resolve_under_grants", "disclosure_audit", "vault_upsert",
    "exact_split", "rendered_turns", "cosine_top_k", "detection_report", "mask_check",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    from cloakframe.plans import ORACLES, QUERIES

    ok, rows, note = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert ok, note
    assert rows > 0


def test_every_oracle_belongs_to_a_query():
    from cloakframe.plans import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
