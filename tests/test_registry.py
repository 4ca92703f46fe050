"""Registered queries agree with their SQL on the small tables, when those are there."""

import os

import pytest

SF = "/root/testdata/sf0.001"
FAST = ["r1_table_height", "r3_required_height", "g2_metric_scale", "g4_local_px_per_mm", "m2_digit_restrict", "m7_level_crossing",
        "q7_adjudicate", "q10_rollup", "c4_consensus_height", "h3_list_scans", "h5_top_violated", "s6_upsert_history",
        "e7_field_stats_documents", "f18_parse_quantity", "f19_parse_month_year", "p9_pick_pass", "t2_stream_history"]


def test_every_query_is_well_formed():
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_matches_sql(spark, name):
    import __spark_entry__ as entry
    from verification.check import compare, connect
    state, rows, _, _, msg = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok" and rows > 0, msg
