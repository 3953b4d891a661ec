"""What the plans must look like, whatever the size of the tables."""

import re

import pytest

from lexiprobe import queries as q
from lexiprobe.operators import groups


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Plans as for tables of which Spark broadcasts nothing by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_of_a_document_stay_where_they_were_written(spark, sf, large):
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan(q.tfidf_weights(spark, sf)))
    assert exchanges == ["term"]  # terms to fit; the texts moved once before


@pytest.mark.parametrize("name", ["minmax_by_group", "complexity_score", "ablation_scores"])
def test_rows_are_not_moved_for_what_their_group_has(spark, sf, large, name):
    got = plan(q.QUERIES[name](spark, sf))
    assert "SortMergeJoin" not in got and "ShuffledHashJoin" not in got and "Exchange hashpartitioning" not in got


def test_many_groups_are_not_broadcast(spark, large):
    table = spark.range(50)
    assert "broadcast" in plan(table.join(groups.per_group(table), "id")).lower()
    assert "broadcast" not in plan(table.join(groups.per_group(table, 49), "id")).lower()


@pytest.mark.parametrize("name", ["tfidf_weights", "qa_process", "minmax_by_group", "classification_metrics", "main_vs_control", "experiment_grid", "best_per_language_task"])
def test_no_cartesian_product(spark, sf, name):
    assert "CartesianProduct" not in plan(q.QUERIES[name](spark, sf))


def test_only_needed_columns_are_read(spark, sf):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(q.qa_en_conversations(spark, sf)))
    assert schema and set(re.findall(r"(\w+):", schema[1])) == {"conv_id", "turn", "text"}


def test_filters_reach_the_scan(spark, sf):
    assert re.search(r"PushedFilters: \[.*IsNotNull\(text\)", plan(q.qa_en_conversations(spark, sf)))


def test_question_rules_run_without_python(spark, sf):
    for name in ("qa_process", "ud_bucket_counts", "agreement_stats", "tfidf_weights", "ablation_scores", "main_vs_control"):
        assert not re.search("Python|Pandas|Arrow", plan(q.QUERIES[name](spark, sf))), name
