"""The driver contract: names, flagship query, and a cross-section of the SQL twins."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "agg03_tail_ratio_change", "agg15_matched_decomposition", "agg18_blocks", "jn01_context_join", "jn08_ball_history", "flt06_admissible_or_all",
    "win04_robust_z", "win13_rank_stability", "smp08_block_bootstrap", "dst03_shift_per_game", "dst07_ks_p_values", "trk06_windows_with_targets", "det01_page_hinkley",
    "det08_smoothed_split", "ens04_two_tier", "evl01_alarm_metrics", "chg02_break_curve", "sc08_names", "src03_csv_coercion", "st04_play_segments",
    "smp10_permuted_order", "st07_clean_tracks",
]


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["model", "year", "n", "tail_ratio", "mean_change_pct", "p99_change_pct"]
    assert df.count() == 35


@pytest.mark.parametrize("name", SAMPLE)
def test_results_equal_the_sql(spark, name):
    want = connect(SF).sql(entry.oracle_sql()[name]).to_arrow_table()
    res = compare(entry.queries()[name](spark, SF).toArrow(), want)
    assert res.startswith("ok ("), res
