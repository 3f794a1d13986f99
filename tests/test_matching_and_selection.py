import math

import pytest
from pyspark.sql import functions as F

from conftest import final_plan, planned, rows
from gradewell.operators import grading as gr
from gradewell.operators import matching as mt
from gradewell.operators import selection as se

SMALL = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "100KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "200KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
}


def hot(spark, name, n=100_000):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000)
    return spark.range(n).select(key.alias(name), F.sha2(F.col("id").cast("string"), 256).alias("text"))


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n")], "id string, seq int, t string")
    assert rows(mt.last_wins(df, "id", "seq")) == [("a", 2, "y"), ("b", None, "z"), (None, 1, "n")]
    tied = df.withColumn("seq", F.lit(1))
    assert rows(mt.last_wins(tied, "id", "seq")) == rows(mt.last_wins(tied.repartition(5), "id", "seq"))


def test_last_wins_keeps_one_row_per_task(spark):
    plan = planned(mt.last_wins(hot(spark, "id"), "id", "text"))
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning")


def test_match_results(spark):
    requests = spark.createDataFrame([("b0-0", "q0"), ("b0-1", "q1"), (None, "q2")], "custom_id string, id string")
    results = spark.createDataFrame(
        [("b0-0", "old", 1), ("b0-0", "new", 2), ("other", "x", 1), (None, "y", 1)], "custom_id string, out string, seq int")
    assert rows(mt.match_results(requests, results, "seq").select("id", "out")) == [("q0", "new")]
    assert rows(mt.match_results(requests, results).select("id", "out")) == [("q0", "new"), ("q0", "old")]
    with pytest.raises(ValueError, match="clashes"):
        mt.match_results(requests, results.withColumnRenamed("out", "ID"))


def test_attach_responses(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "id string, n int")
    responses = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("c", "x", 1)], "id string, response string, seq int")
    want = [("a", 1, "new"), ("a", 2, "new"), ("b", 3, ""), (None, 4, "")]
    assert rows(mt.attach_responses(df, responses, seq="seq")) == want
    assert rows(mt.attach_responses(df, responses.where("response <> 'old'"))) == want
    with pytest.raises(ValueError, match="clashes"):
        mt.attach_responses(df, responses, output_col="N")


@pytest.mark.parametrize("seq", [None, "seq"])
def test_hot_id_is_split(spark, settings, seq):
    settings(**SMALL)
    df = hot(spark, "id")
    responses = spark.range(1000).select("id", F.lit("r").alias("response"), F.lit(1).alias("seq"))
    out = mt.attach_responses(df, responses, seq=seq)
    assert "SortMergeJoin(skew=true)" in final_plan(out)
    assert out.count() == df.count()


def test_hot_batch_is_split(spark, settings):
    settings(**SMALL)
    states = spark.range(1000).select(
        F.col("id").alias("batch_no"), F.when(F.col("id") == 9, "processing").otherwise("succeeded").alias("status"))
    results = hot(spark, "batch_no")
    kept = mt.of_ended_batches(results, gr.batch_status(states))
    assert "SortMergeJoin(skew=true)" in final_plan(kept)
    assert kept.count() == results.where("batch_no <> 9").count()


def test_pair_scores(spark):
    candidates = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b")], "question_id string, sample_no int, response string")
    scores = spark.createDataFrame([("q", 1, 0.5)], "question_id string, sample_no int, score double")
    assert rows(mt.pair_scores(candidates, scores)) == [("q", 1, "b", 0.5)]


def test_batch_status(spark):
    df = spark.createDataFrame(
        [(0, "succeeded"), (0, "errored"), (1, "processing"), (1, "canceled"), (2, "expired"),
         (3, "in_progress"), (4, None), (4, "succeeded")], "batch_no int, status string")
    assert rows(gr.batch_status(df)) == [
        (0, 1, 0, 1, 0, 0, 0, True), (1, 0, 1, 0, 1, 0, 0, False), (2, 0, 0, 0, 0, 1, 0, True),
        (3, 0, 0, 0, 0, 0, 1, False), (4, 1, 0, 0, 0, 0, 1, False)]


# --- selection ---------------------------------------------------------------

CANDIDATES = [  # question, sample, response, score
    ("tie", 0, "a", 1.0), ("tie", 1, "b", 1.0), ("nan", 0, "a", 0.1), ("nan", 1, "b", math.nan),
    ("null", 1, "b", None), ("null", 0, "a", None), ("top", 0, "z", -2.0), ("top", 2, "a", 3.0), ("top", 1, None, 0.0),
]
BEST = [("nan", 0, "a", 0.1), ("null", 0, "a", None), ("tie", 0, "a", 1.0), ("top", 2, "a", 3.0)]


@pytest.fixture
def candidates(spark):
    return spark.createDataFrame(CANDIDATES, "question_id string, sample_no int, response string, score double")


def test_best_of_n(candidates):
    assert rows(se.best_of_n(candidates)) == BEST
    assert rows(se.best_of_n(candidates, keep_unscored=False)) == [r for r in BEST if r[0] != "null"]


def test_best_of_one_row(candidates):
    arrays = candidates.orderBy("question_id", "sample_no").groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("sample_no", "response", "score"))).alias("c"))
    best = arrays.select("question_id", se.best_candidate(F.col("c.response"), F.col("c.score")).alias("b"))
    got = rows(best.select("question_id", "b.sample_no", "b.response", "b.score"))
    assert got == BEST


def test_expansion(spark):
    assert rows(se.expand_samples(spark.range(1), 3)) == [(0, 0), (0, 1), (0, 2)]
    assert "Exchange" not in planned(se.expand_samples(spark.range(9), 3))
    with pytest.raises(ValueError):
        se.expand_samples(spark.range(1), 0)


def test_group_candidates(candidates):
    grouped = se.group_candidates(candidates, 3)
    assert rows(grouped) == [
        ("nan", ["a", "b", None]), ("null", ["a", "b", None]), ("tie", ["a", "b", None]), ("top", ["z", None, "a"])]
    with pytest.raises(Exception, match="sample number outside"):
        se.group_candidates(candidates, 2).collect()


# --- metrics -----------------------------------------------------------------


def test_metrics(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 1.0), (None, 0.0), (True, None)], "is_correct boolean, confidence_score double")
    assert rows(gr.metrics(df)) == [(0.5, 4, 2, 0.5)]
    assert rows(gr.metrics(df.drop("confidence_score"))) == [(0.5, 4, 2, None)]
    assert rows(gr.metrics(df.where("false"))) == [(None, 0, 0, None)]
    assert gr.wrong_answers(df).count() == 2


def test_two_rows_for_one_sample_fail(spark):
    df = spark.createDataFrame([("q", 0, "a"), ("q", 0, "b")], "question_id string, sample_no int, response string")
    with pytest.raises(Exception, match="two rows for one sample number"):
        se.group_candidates(df, 2).collect()
