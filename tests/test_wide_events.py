from __future__ import annotations

import pytest

import test_catalog


@pytest.mark.parametrize("name", ["r01_event_connections_wide", "r10_external_connectivity_wide", "r13_risk_scores_wide", "r15_risk_stats_wide"])
def test_wide_events_equal_their_oracles(spark, name):
    test_catalog.test_queries_equal_their_oracles(spark, name)
