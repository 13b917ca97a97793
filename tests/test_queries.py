"""Queries against their SQL on the small tables."""

import pytest

from hunkflow.plans import all_queries

QUERIES = {n: q for n, q in all_queries().items() if q[1]}
#: These repeat the work of others over the same findings.
SLOW = {"findings", "deduped_findings", "hl_patches", "ev_score_labels"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_equals_sql(same, name):
    same(*QUERIES[name])
