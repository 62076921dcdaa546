"""Registered queries next to their SQL on the smallest supplied data.

A sample by default; REKINDLE_ALL_QUERIES=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect, rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "g1_count_window", "g3_amount_stats_many_days", "g4_normalised_count", "g7_zscore_vs_population", "g8_category_entropy", "g9_first_view_lag_many_days",
    "g10_views_between_purchases_many_days", "g11_views_since_last_purchase", "g12_category_similarity", "l3_sample_data", "l8_majority_downsample", "k1_recent_topk",
    "x4_purchase_history_min", "x6_search_history", "x12_recs_log_sample", "v13_attribute_map", "v17_packed_item_join", "j10_future_label_join", "y1_binary_metrics",
    "y3_segment_metrics", "y4_roc_curve", "y8_feature_quantiles", "y11_histogram_divergence", "y14_recs_replay_lift", "count_grid", "a5_csv_extract",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("REKINDLE_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    cols, _, got = rows_of(contract.queries()[name](spark, FOLDER))
    want_cols, _, want = sql_rows(con, contract.oracle_sql()[name])
    assert cols == want_cols
    assert got == want


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
