import pytest

from promptledger.plans import files, oracle, queries
from tests.compare import assert_same

ALL = queries.QUERIES | files.QUERIES
SQL = oracle.ORACLE_SQL | files.ORACLE_SQL
#: The others differ from these by one aggregate or column.
CHECKED = (
    "prompt_cost merge_prompts merge_requests merge_tool_calls merge_edits merge_sessions null_key_passthrough asof_canonical fold_injected project_display project_fill "
    "attribution_ffill attribution_file_first promo_rate cost_components tool_histogram prompt_agents top_files unpriced_models prompt_usage blocks_5h blocks_5h_by_user current_block "
    "digest_totals digest_by_family digest_top10 project_subtotals daily_cost_per_kloc daily_model_mix live_audit manifest_latest manifest_changed patch_stats injected_flag "
    "event_routing human_numbers iso_week filtered_view transcript_scan transcript_prompts otlp_scan stream_ingest stream_asof stream_asof_late digest_sink "
    "transcript_tools transcript_edits transcript_sessions reconcile silver_union silver_tools live_refresh live_block folded_union forced_reconcile live_counts live_prompts live_tools usage_lists cost_labels payload_sink payload_window csv_export"
).split()


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, small, name):
    assert_same(spark, small, ALL[name], SQL[name])
