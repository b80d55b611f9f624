"""Registered queries against their SQL twins on the smallest tables; all of them with FLEETSPAN_ALL=1."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests import compare

CORE = [
    "fact_cube", "cube_rollup", "network_kpis", "route_rollup", "courier_scorecard", "rank_in_region", "fleet_utilisation", "site_throughput", "elasticities",
    "nearest_sites", "run_distances", "event_window_tags", "prior_error_rate", "rolling_rows_mean", "cumulative_revenue_share", "masked_orders", "detected_duplicates",
    "numeric_profile", "feature_table", "temporal_split", "task_warehouse_congestion", "classification_metrics", "demand_forecast", "scenario_table", "recommendations",
    "greedy_sites", "stream_windowed_volume", "stream_latest_per_user", "stream_sessions", "cube_reconciliation",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FLEETSPAN_ALL") else CORE


@pytest.fixture(scope="module")
def duck(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    state, n, _, note = compare.check(spark, duck, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state.startswith("OK"), note


def test_every_query_is_named_once_and_has_a_builder():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180


def test_entry(spark):
    df = entry.entry(spark)
    assert {"region", "month", "on_time", "revenue", "cost", "margin"} <= set(df.columns) and df.count() > 0
