"""Every core query with SQL gives in Spark what its SQL gives in DuckDB."""

import pytest
from compare import both

from stockloom.plans import detections, folds, ledger, motion, review, scenes

SF = "/root/testdata/sf0.001"
QUERIES = detections.QUERIES | motion.QUERIES | ledger.QUERIES | folds.QUERIES | review.QUERIES | scenes.QUERIES
SQL = detections.ORACLE_SQL | motion.ORACLE_SQL | ledger.ORACLE_SQL | folds.ORACLE_SQL | review.ORACLE_SQL | scenes.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    columns, mine, their_columns, theirs = both(spark, SF, QUERIES[name], SQL[name])
    assert columns == their_columns
    assert mine == theirs


def test_plans_have_no_cartesian_product(spark):
    for name in ("q28_gated_new", "q30_offset_votes", "q31_zone_prompts", "q33_view_range_join", "q35_best_sightings", "q37_knn_top3", "q59_detector_metrics", "q99_view_overlaps", "q100_zone_questions", "q101_proposed_pairs", "q108_zone_fits", "q71_consistent_links"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
