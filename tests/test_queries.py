import pytest

import __spark_entry__
from emberline import oracles
from emberline import queries as own
from tests.helpers import oracle_rows, rows_of

QUICK = ["bbox_scan", "dedup_merge", "combine_years", "date_chunks", "grid_groups", "top20_cells", "grid_scales", "event_edges", "quantile_summary", "daynight", "time_concentration", "gaps", "two_source_ingest", "ingest_runs", "frp_histogram", "median_report"]
SLOW = ["event_table", "event_behavior", "frp_trend", "nearest_evidence", "cluster_stats", "osm_topk", "cross_year", "ari_nmi", "metrics", "stream_cycle", "cross_date_pairs", "redundancy_audit", "joined_features", "top_lists", "fixed_radius_lookup", "feature_pairs", "tier_counts", "category_crosstab", "osm_nearest_named", "event_components_rounds", "change_feed", "date_order", "feature_matrix", "ward_heights", "window_diversity", "figure_heat"]


@pytest.mark.parametrize("name", QUICK + SLOW)
def test_query_matches_its_oracle(spark, small, name):
    df = own.QUERIES[name](spark, small)
    expected, columns = oracle_rows(oracles.ORACLES[name], small)
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


def test_every_oracle_has_a_query():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert set(oracles.ORACLES) <= set(own.QUERIES)


def test_entry_runs(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
