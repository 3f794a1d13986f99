"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as entry_points
from conftest import TESTDATA, planned
from gradewell.catalog import QUERIES, SQL
from oracle import connect, differences

# Queries of the llm folder have tests of their own.


@pytest.fixture(scope="module")
def small():
    return connect(f"{TESTDATA}/sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, small, name):
    assert differences(QUERIES[name](spark, f"{TESTDATA}/sf0.01"), small, SQL[name]) == []


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.columns == ["prompt", "chosen", "rejected"] and out.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


WITH_MODEL = {"execute_answers", "execute_by_length", "graded_best_of_n", "response_status", "best_of_n_answers", "grade_answers", "feedback_made_in_place"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_only_models_run_python(spark, name):
    plan = planned(QUERIES[name](spark, f"{TESTDATA}/sf0.001"))
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) <= (name in WITH_MODEL)


MAP_ONLY = [
    "boxed_answer", "tag_extract", "clean_text", "code_block", "strip_text", "upper_case_fields", "question_prompt",
    "feedback_prompt", "judge_prompts", "chat_texts", "verdict_contains", "verdict_strict", "confidence",
    "confidence_of_probabilities", "score_mean", "keep_corrected", "flag_missing", "wrong_answers", "execute_answers",
    "response_status", "best_of_n_answers", "grade_answers", "sample_expansion",
]


@pytest.mark.parametrize("name", MAP_ONLY)
def test_row_functions_do_not_shuffle(spark, name):
    assert "Exchange" not in planned(QUERIES[name](spark, f"{TESTDATA}/sf0.001"))


def test_columns_and_filters_reach_the_scan(spark):
    sf = f"{TESTDATA}/sf0.001"
    plan = planned(QUERIES["keep_corrected"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    plan = planned(QUERIES["qa_pairs"](spark, sf))
    assert "EqualTo(role,user)" in plan and "EqualTo(role,assistant)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_tax:double>" in planned(
        QUERIES["confidence"](spark, sf))
