import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import planned, rows
from gradewell import session
from gradewell.catalog import plans as stubs
from gradewell.fixed import FEEDBACK_TEMPLATE, QUESTION_TEMPLATE
from gradewell.operators import grading as gr
from gradewell.operators.inference import JUDGEMENT, SCORE, answer_requests, model_output
from gradewell.plans.evaluation import evaluate, grade, write_graded
from gradewell.plans.execution import best_of_n_responses, execute, response_records
from gradewell.plans.feedback import feedback_requests, parse_feedback
from gradewell.plans.preference import preference_pairs, preference_set
from gradewell.plans.questions import flag_missing, parse_questions, question_requests

# Python workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def make_upper():
    def run(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("bad text")
        return [t.upper() for t in texts]

    return run


# --- model calls -------------------------------------------------------------


def test_a_bad_row_costs_only_itself(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "t string").coalesce(1)
    out = df.select("t", model_output(make_upper, F.col("t"), 8).alias("o")).select("t", "o.*")
    assert rows(out) == [
        ("a", "A", "success", None), ("b", "B", "success", None), ("bad", "", "error", "bad text")]


def test_batches_and_loading(spark):
    """Batches hold at most batch_size rows, and the model loads once per worker."""

    def make():
        import os
        import uuid

        loaded = f"{os.getpid()}/{uuid.uuid4().hex}"
        return lambda texts: [f"{loaded} {len(texts)}"] * len(texts)

    df = spark.range(1000, numPartitions=4).select(F.col("id").cast("string").alias("t"))
    out = df.select(model_output(make, F.col("t"), 7)["response"].alias("r")).collect()
    sizes = {int(r.r.split()[1]) for r in out}
    loads = {r.r.split()[0] for r in out}
    assert max(sizes) == 7 and len(sizes) == 2
    assert len(loads) == len({load.split("/")[0] for load in loads})


def test_texts_wait_in_arrow_for_their_batch(spark):
    """A worker makes Python's texts of one batch at a time, not of all rows it was sent."""

    def make():
        import tracemalloc

        tracemalloc.start()

        def held(texts):
            most = tracemalloc.get_traced_memory()[1]
            if "end" in texts:
                tracemalloc.stop()
            return [str(most)] * len(texts)

        return held

    df = spark.range(2000, numPartitions=1).select(F.when(F.col("id") == 1999, "end").otherwise(F.repeat(F.col("id").cast("string"), 3000)).alias("t"))
    most = df.select(model_output(make, F.col("t"), 8)["response"].cast("long").alias("r")).agg(F.max("r"), F.count("r")).first()
    assert most[1] == 2000 and most[0] < 4_000_000


def test_no_number_is_no_score(spark):
    df = spark.createDataFrame([("1",), ("nan",)], "t string").coalesce(1)
    make = lambda: lambda texts: [float(t) for t in texts]
    assert rows(df.select(model_output(make, F.col("t"), 5, SCORE)["score"])) == [(1.0,), (None,)]
    both = df.select(model_output(make, F.array(F.lit("nan"), "t"), 5, SCORE, places=2)["score"])
    assert rows(both) == [([None, 1.0],), ([None, None],)]
    with pytest.raises(Exception, match="a row has not 3 texts"):
        df.select(model_output(make, F.array("t"), 5, SCORE, places=3)["score"]).collect()


def test_wrong_number_of_results_is_an_error(spark):
    out = spark.createDataFrame([("a",), ("b",)], "t string").select(
        model_output(lambda: lambda texts: ["x"] * 3, F.col("t"), 5).alias("o")).select("o.*")
    assert {r.status for r in out.collect()} == {"error"}


def test_unusable_values_are_errors_of_their_row(spark):
    df = spark.createDataFrame([("1",), ("x",), ("2.5",)], "t string").coalesce(1)
    scored = df.select("t", model_output(lambda: lambda ts: ts, F.col("t"), 5, SCORE).alias("o")).select("t", "o.score", "o.status")
    assert {(r.t, r.status) for r in scored.collect()} == {("1", "success"), ("x", "error"), ("2.5", "success")}
    assert scored.where("t = '2.5'").first().score == 2.5
    judged = df.select(model_output(lambda: lambda ts: [("a", 1.0)] * len(ts), F.col("t"), 5, JUDGEMENT).alias("o"))
    assert {r.error for r in judged.select("o.*").collect()} == {"model gave 2 values for 3 fields"}


def test_several_fields_and_samples(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    judged = df.select(model_output(lambda: lambda ts: [("Wrong", 1, 2.5)] * len(ts), F.col("t"), 5, JUDGEMENT).alias("o"))
    assert rows(judged.select("o.*")) == [("Wrong", 1.0, 2.5, "success", None)]
    draw = lambda: lambda ts, ns: [f"{t}{n}" for t, n in zip(ts, ns)]
    drawn = df.select(model_output(draw, F.col("t"), 2, samples=3)["response"].alias("r"))
    assert drawn.first().r == ["ab0", "ab1", "ab2"]
    scored = df.select(model_output(
        lambda: lambda ts: [len(t) for t in ts], F.array(F.lit("a"), F.col("t")), 5, SCORE, places=2)["score"].alias("s"))
    assert scored.first().s == [1.0, 2.0]


def test_only_the_text_goes_to_python_and_one_call_is_made(spark):
    df = spark.createDataFrame([("q", "wide")], "question string, other string")
    plan = planned(execute(df, "question", make_upper, status=True))
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan and "Exchange" not in plan


# --- executing ---------------------------------------------------------------


def echo():
    return lambda chats: [c.split("user\n")[1].split("<|im_end|>")[0] for c in chats]


def test_execute_keeps_every_row(spark):
    df = spark.createDataFrame([("x", "q1"), ("x", "q2"), (None, None)], "temp_id string, question string")
    out = execute(df, "question", echo, mode="tir")
    assert rows(out) == [("x", "q1", "q1"), ("x", "q2", "q2"), (None, None, "None")]
    with pytest.raises(ValueError, match="missing"):
        execute(df, "nothing", echo)
    with pytest.raises(ValueError, match="unknown mode"):
        execute(df, "question", echo, mode="other")


def test_response_records(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "n int, q string")

    def make():
        return lambda chats: [make_upper()([echo()([c])[0]])[0] for c in chats]

    assert rows(response_records(df, "q", "n", make)) == [
        ("1", "a", "A", "success", None), ("2", "bad", "", "error", "bad text")]


def test_best_of_n(spark):
    df = spark.createDataFrame([("q",), ("qq",)], "question string")

    def sampler():
        def draw(chats, numbers):
            if any(n == 3 for n in numbers):
                raise RuntimeError("no third sample")
            return [f"s{n}" for n in numbers]

        return draw

    def scorer():
        # Sample 1 is best, but the failed sample's empty text would score higher still.
        scores = {"s0": 0.5, "s1": 2.0, "s2": 2.0, "": 9.0}
        return lambda chats: [scores[stubs._last_turn(c, "assistant")] for c in chats]

    out = best_of_n_responses(df, "question", sampler, scorer, 4, score_col="score", batch_size=3)
    assert rows(out) == [("q", "s1", 2.0), ("qq", "s1", 2.0)]
    assert "Exchange" not in planned(out)


# --- grading -----------------------------------------------------------------


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(
        [("a", "q1", r"\boxed{4}", "4"), ("b", "q2", r"\boxed{5}", "6"), ("c", "q3", "none", "7"), ("d", None, None, None)],
        "id string, question string, response string, answer string")


def test_grade(answers):
    graded = grade(answers, "question", "response", "answer", stubs.make_judge)
    assert graded.columns == [*answers.columns, "extracted_answer", "model_evaluation", "is_correct"]
    assert rows(graded.select("id", "extracted_answer", "model_evaluation", "is_correct")) == [
        ("a", "4", "Correct", True), ("b", "5", "Wrong", False), ("c", None, "Wrong", False), ("d", None, "Correct", True)]


def test_failed_judgement_is_neutral(answers):
    def broken():
        def run(chats):
            raise RuntimeError("out of memory")

        return run

    graded = grade(answers, "question", "response", "answer", broken, with_confidence=True, status=True)
    assert {(r.judge_status, r.judge_error) for r in graded.collect()} == {("error", "out of memory")}
    assert {(r.model_evaluation, r.is_correct, r.confidence_score) for r in graded.collect()} == {("", False, 0.5)}


def test_rules(answers):
    judge = lambda: lambda chats: ["Incorrect"] * len(chats)
    options = ("question", "response", "answer", judge)
    assert gr.metrics(grade(answers, *options)).first().accuracy == 0.0
    assert gr.metrics(grade(answers, *options, rule="contains")).first().accuracy == 1.0


def test_evaluate_and_metrics_in_one_pass(spark, answers):
    judged = spark.sparkContext.accumulator(0)

    def judge():
        def run(chats):
            judged.add(len(chats))
            return ["Correct"] * len(chats)

        return run

    graded, metrics = write_graded(evaluate(answers, "question", "answer", judge, response_col="response"))
    assert metrics == {"accuracy": 1.0, "total_samples": 4, "correct_samples": 4, "average_confidence": None}
    assert gr.metrics(graded).first().asDict() == metrics
    assert judged.value == 4


def test_evaluate_makes_responses(answers):
    options = {"make_judge_fn": stubs.make_judge, "make_fn": stubs.make_answerer}
    graded = evaluate(answers.drop("response"), "question", "answer", **options)
    assert {r.model_response for r in graded.collect()} == {r"It has \boxed{2} characters.", r"It has \boxed{4} characters."}
    best = evaluate(
        answers, "question", "answer", stubs.make_judge, make_fn=stubs.make_sampler, make_score_fn=stubs.make_scorer,
        n_samples=2, with_confidence=False)
    assert best.count() == 4
    with pytest.raises(ValueError, match="response_col"):
        evaluate(answers, "question", "answer", stubs.make_judge)


# --- records -----------------------------------------------------------------


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(
        [("1", "text {{QUESTION}}", [["a", "b"]], "what?", 4.5), ("2", None, None, "who?", None), ("2", "again", None, "why?", 2.0)],
        "id string, pre_text string, table array<array<string>>, question string, answer double")


def test_question_requests(questions):
    requests = question_requests(questions, batch_size=2, order_by=["id", "question"], total_samples=3)
    assert requests.columns == [
        "custom_id", "batch_no", "pos", "id", "PRE_TEXT", "TABLE", "QUESTION", "ANSWER", "PROMPT"]
    assert rows(requests.select("custom_id", "id", "PRE_TEXT", "TABLE", "QUESTION", "ANSWER")) == [
        ("b0-0", "1", "text {{QUESTION}}", '[["a","b"]]', "what?", "4.5"),
        ("b0-1", "2", "None", "None", "who?", "None"), ("b1-0", "2", "again", "None", "why?", "2.0")]
    prompt = requests.where("id = '1'").first().PROMPT
    assert "<pre_text>\ntext what?\n</pre_text>" in prompt
    assert "<question>what?</question>\n<answer>4.5</answer>" in prompt
    assert "{{GOLD_EVIDENCE}}" in prompt  # no such column
    assert "<table>\nNone\n</table>" in requests.where("custom_id = 'b0-1'").first().PROMPT


@pytest.mark.parametrize("name", ["ID", "analysis", "Prompt", "fmt_question", "pos"])
def test_clashing_source_fields(questions, name):
    with pytest.raises(ValueError, match="clashes"):
        question_requests(questions.withColumn("x", F.lit(1)).toDF(*questions.columns, name))


@pytest.mark.parametrize("options", [{}, {"template": QUESTION_TEMPLATE}])
def test_parse_questions(spark, questions, options):
    requests = question_requests(questions, batch_size=2, order_by=["id", "question"])
    results = spark.createDataFrame([
        ("b0-0", "<analysis> one\n\n two </analysis><new_question>new?</new_question>"),
        ("b0-1", "<analysis>x</analysis><new_question>y</new_question>"),
        ("b1-0", "<analysis>last</analysis>"), ("b9-9", "<analysis>foreign</analysis>"), ("b0-0", None),
    ], "custom_id string, MODEL_OUTPUT string")
    records = parse_questions(requests, results, **options)
    assert records.columns == ["ANALYSIS", "FMT_QUESTION", "id", "PROMPT", "PRE_TEXT", "TABLE", "QUESTION", "ANSWER"]
    assert rows(flag_missing(records).select("id", "ANALYSIS", "FMT_QUESTION", "QUESTION", "missing")) == [
        ("1", "one\ntwo", "new?", "what?", None), ("2", "last", "", "why?", "question")]
    prompts = {r.id: r.PROMPT for r in requests.where("custom_id <> 'b0-1'").collect()}
    assert {r.id: r.PROMPT for r in records.collect()} == prompts


def test_repeated_results_keep_the_last(spark, questions):
    requests = question_requests(questions, order_by=["id", "question"])
    results = spark.createDataFrame(
        [("b0-0", f"<analysis>{i}</analysis>", i) for i in range(3)], "custom_id string, MODEL_OUTPUT string, n int")
    records = parse_questions(requests, results, seq="n", template=QUESTION_TEMPLATE)
    assert rows(records.select("id", "ANALYSIS")) == [("1", "2")]
    assert records.columns == ["ANALYSIS", "FMT_QUESTION", "id", "PROMPT", "PRE_TEXT", "TABLE", "QUESTION", "ANSWER"]


def test_prompts_are_not_shuffled(spark, questions, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    requests = question_requests(questions)
    results = requests.select("custom_id", F.col("PROMPT").alias("MODEL_OUTPUT"))
    plan = planned(parse_questions(requests, results, template=QUESTION_TEMPLATE, unique_ids=True))
    assert plan.count("Exchange hashpartitioning") == 2
    left = plan.split("SortMergeJoin")[1].split("Exchange")[1]
    assert "PROMPT" not in left and "financial analyst" in plan.split("SortMergeJoin")[0]


@pytest.fixture
def wrong(spark):
    return spark.createDataFrame(
        [(1, "2+2?", "4", "I say 5", "5"), (2, "1+1?", "2", None, None), (3, "0?", "0", "1", "1")],
        "id int, question string, answer string, cot_response string, extracted_answer string")


def test_feedback(spark, wrong):
    requests = feedback_requests(wrong, batch_size=2, order_by=["id"])
    prompt = requests.where("id = '1'").first().PROMPT
    assert prompt.count("<reference_answer>4</reference_answer>") == 1
    assert "<reference_answer>\n4\n</reference_answer>" in prompt and "<ai_answer>\n5\n</ai_answer>" in prompt
    assert "<ai_reasoning>\nNone\n</ai_reasoning>" in requests.where("id = '2'").first().PROMPT
    results = spark.createDataFrame([
        ("b0-0", "<corrected_response>\n I say 4 \n</corrected_response>"), ("b0-1", "<corrected_response> </corrected_response>"),
        ("b1-0", "no tag"), ("b1-0", None)], "custom_id string, MODEL_OUTPUT string")
    for options in ({}, {"template": FEEDBACK_TEMPLATE}):
        records = parse_feedback(requests, results, **options)
        assert records.columns == ["CORRECTED_RESPONSE", "id", "PROMPT", "QUESTION", "ANSWER", "COT_RESPONSE", "EXTRACTED_ANSWER"]
        assert rows(records) == [("I say 4", "1", prompt, "2+2?", "4", "I say 5", "5")]


def test_corrections_are_extracted_once(spark, wrong):
    requests = feedback_requests(wrong)
    results = requests.select("custom_id", F.col("PROMPT").alias("MODEL_OUTPUT"))
    assert planned(parse_feedback(requests, results, template=FEEDBACK_TEMPLATE, unique_ids=True)).count("regexp_extract(") == 1


def test_feedback_mapping(wrong):
    renamed = wrong.withColumnsRenamed({"question": "q", "cot_response": "r"})
    with pytest.raises(ValueError, match="missing"):
        feedback_requests(renamed)
    mapping = {"question": "q", "answer": "answer", "cot_response": "r", "extracted_answer": "extracted_answer"}
    assert rows(feedback_requests(renamed, mapping)) == rows(feedback_requests(wrong))


def test_answers_made_in_place(wrong):
    """With a model run by Spark the output stays in its row: no join, and no shuffle for unique ids."""
    requests = feedback_requests(wrong)

    def make():
        return lambda prompts: ["<corrected_response>fixed</corrected_response>" if "I say 5" in p else "no" for p in prompts]

    answered = answer_requests(requests, make, 2)
    assert rows(answered.select("id", "status")) == [("1", "success"), ("2", "success"), ("3", "success")]
    records = parse_feedback(answered, template=FEEDBACK_TEMPLATE, unique_ids=True)
    assert rows(records.select("id", "CORRECTED_RESPONSE")) == [("1", "fixed")]
    assert "Exchange hashpartitioning" not in planned(records) and "SortMergeJoin" not in planned(records)


# --- preference triples ------------------------------------------------------


def test_preference_pairs(spark):
    df = spark.createDataFrame(
        [("q", "good", "bad"), (None, "good", "bad"), ("q", None, "bad"), ("q", "good", None)],
        "QUESTION string, CORRECTED_RESPONSE string, AI_RESPONSE string")
    pairs = preference_pairs(df)
    assert pairs.columns == ["prompt", "chosen", "rejected"] and pairs.count() == 2
    assert "<|im_start|>user\nNone<|im_end|>" in " ".join(r.prompt for r in pairs.collect())
    kept = preference_pairs(df, null_policy="text")
    assert sorted((r.chosen, r.rejected) for r in kept.collect()) == [
        ("None", "bad"), ("good", "None"), ("good", "bad"), ("good", "bad")]
    with pytest.raises(ValueError, match="no rows given"):
        preference_pairs(None)
    with pytest.raises(ValueError, match="null_policy"):
        preference_pairs(df, null_policy="keep")
    with pytest.raises(ValueError, match="unknown mode"):
        preference_pairs(df, mode="other")
    with pytest.raises(ValueError, match="missing"):
        preference_pairs(df, chosen_col="other")


@pytest.mark.parametrize("parts", [1, 8])
def test_preference_set(answers, parts):
    graded, _ = write_graded(grade(answers.repartition(parts), "question", "response", "answer", stubs.make_judge))
    triples = preference_set(
        graded, stubs.corrections, "id", "question", "answer", "response", order_by=["id"])
    assert [r[1:] for r in rows(triples)] == [
        (r"\boxed{5} so \boxed{6}", r"\boxed{5}"), (r"none so \boxed{7}", "none")]
    path = session.scratch_path(triples.sparkSession, "triples")
    triples.write.parquet(path)
    assert rows(triples.sparkSession.read.parquet(path)) == rows(triples)


def test_results_delivered_twice_and_repeated_ids(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    df = spark.createDataFrame([("a", "x1"), ("b", "x2"), ("a", "x3")], "id string, question string")
    requests = question_requests(df, "{{QUESTION}}", batch_size=2, order_by=["question"])
    results = requests.select("custom_id", F.concat(F.lit("<analysis>"), "QUESTION", F.lit("</analysis>")).alias("MODEL_OUTPUT"))
    twice = results.union(results)
    for unique in (True, False):
        out = parse_questions(requests, twice, template="{{QUESTION}}", unique_ids=unique)
        got = sorted((r.id, r.ANALYSIS) for r in out.collect())
        assert got == ([("a", "x1"), ("a", "x3"), ("b", "x2")] if unique else [("a", "x3"), ("b", "x2")])
    plan = planned(parse_questions(requests, twice, template="{{QUESTION}}"))
    assert not [line for line in plan.split("\n") if "Aggregate" in line and re.search("(?<!_)QUESTION#", line)]


def test_only_wrong_answers_are_rejected(spark):
    columns = "id string, question string, answer string, response string, extracted_answer string, is_correct boolean, judge_status string, response_status string"
    rows = [(str(i), "q", "a", r, None, False, j, s) for i, (r, j, s) in enumerate([
        ("wrong", "success", "success"), (None, "success", "success"), ("", "success", "success"),
        ("unjudged", "error", "success"), ("failed", "success", "error"), ("wrong too", None, None)])]
    graded = spark.createDataFrame(rows, columns)

    def respond(requests):
        return requests.select("custom_id", F.lit("<corrected_response>right</corrected_response>").alias("MODEL_OUTPUT"))

    kept = preference_set(graded, respond, "id", "question", "answer", "response")
    assert sorted(r.rejected for r in kept.collect()) == ["wrong", "wrong too"]
    kept = preference_set(graded, respond, "id", "question", "answer", "response", null_policy="text")
    assert sorted(r.rejected for r in kept.collect()) == ["None", "wrong", "wrong too"]
