"""What the physical plans must and must not contain."""

import pytest

from askframe.plans import workloads

SF = "/root/testdata/sf0.001"
PYTHON = {
    "json_numbers", "raw_json_documents", "raw_json_leaves", "request_validation", "request_questions",
    "request_quarantine", "preset_requests", "tokenize_documents", "score_sequences",
    "predict_turns", "predict_decisions", "result_json_text", "order_contexts", "raw_json_deep",
    "request_predict", "request_route",
}
RUN_JOBS = {"write_and_read_results", "stream_requests", "stream_bodies", "catalog_files"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(workloads.QUERIES) - RUN_JOBS))
def test_no_cross_join_and_no_python_where_native(spark, name):
    plan = plan_of(workloads.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    uses_python = any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))
    assert uses_python == (name in PYTHON)
    assert "BatchEvalPython" not in plan


def test_scans_read_needed_columns_only(spark):
    plan = plan_of(workloads.language_agreement(spark, SF))
    assert "ReadSchema: struct<text:string,lang:string>" in plan
    plan = plan_of(workloads.workflow_match(spark, SF))
    assert "o_totalprice" not in plan


def test_filters_do_not_repeat_detection(spark):
    """A filter on a detected value stays above the projections that compute it."""
    df = workloads.route_documents(spark, SF).filter("script = 'latin' AND language IS NULL")
    plan = plan_of(df)
    assert plan.count("regexp_extract_all") == 1


def test_row_wise_queries_do_not_shuffle(spark):
    for name in ("route_documents", "email_clean_threads", "json_conversations", "request_validation",
                 "tokenize_documents", "decision_rows", "question_heads", "token_usage"):
        plan = plan_of(workloads.QUERIES[name](spark, SF))
        shuffles = plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        # token_usage groups the questions of the five presets, nothing else.
        assert shuffles <= (1 if name == "token_usage" else 0), name


def test_routing_comes_before_the_prefixes(spark):
    """The ids of questions meet a request after detection, and for its own checkpoint only."""
    plan = plan_of(workloads.predict_turns(spark, SF))
    assert plan.index("prefixes") < plan.index("regexp_extract_all")  # plans list the last step first
