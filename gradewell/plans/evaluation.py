"""Grading responses with a judge, and metrics over the grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gradewell.fixed import BEST_OF_N, GENERATION_BATCH_SIZE
from gradewell.functions.chat import CHATML, ChatFormat, judge_chat_text
from gradewell.functions.text import boxed_answer
from gradewell.functions.verdict import confidence_from_logits, is_correct
from gradewell.operators.grading import metric_columns
from gradewell.operators.inference import JUDGEMENT, TEXT, MakeFn, model_output
from gradewell.operators.schema import fresh, quoted, require_columns, require_distinct, text_column
from gradewell.plans.execution import best_of_n_responses, execute
from gradewell.session import scratch_path


def grade(
    df: DataFrame,
    question_col: str,
    response_col: str,
    answer_col: str,
    make_judge_fn: MakeFn,
    with_confidence: bool = False,
    rule: str = "strict",
    system_prompt: str | None = None,
    batch_size: int = GENERATION_BATCH_SIZE,
    fmt: ChatFormat = CHATML,
    status: bool = False,
) -> DataFrame:
    """``df`` with ``extracted_answer, model_evaluation, is_correct`` and, on
    request, ``confidence_score``.

    The judge gets its whole chat as text and gives its evaluation, or with
    confidence the evaluation and the logits of "correct" and "wrong".  A failed
    judgement is '' with neutral confidence and counts as not correct; ``status``
    adds ``judge_status`` and ``judge_error`` to tell it from a real one.
    """
    require_columns(df, question_col, response_col, answer_col)
    added = ["extracted_answer", "model_evaluation", "is_correct"]
    added += ["confidence_score"] * with_confidence + ["judge_status", "judge_error"] * status
    require_distinct([*df.columns, *added])
    judged = fresh(df, "_judged")
    out = df.withColumn("extracted_answer", boxed_answer(quoted(response_col).cast("string")))
    asked = judge_chat_text(
        text_column(df, question_col), F.col("extracted_answer"), text_column(df, answer_col), system_prompt, fmt)
    fields = JUDGEMENT if with_confidence else TEXT
    out = out.withColumn(judged, model_output(make_judge_fn, asked, batch_size, fields))
    out = out.withColumn("model_evaluation", F.coalesce(f"{judged}.response", F.lit("")))
    out = out.withColumn("is_correct", is_correct("model_evaluation", rule))
    if with_confidence:
        out = out.withColumn(
            "confidence_score", confidence_from_logits(F.col(f"{judged}.correct_logit"), F.col(f"{judged}.wrong_logit")))
    if status:
        out = out.withColumns({"judge_status": F.col(f"{judged}.status"), "judge_error": F.col(f"{judged}.error")})
    return out.drop(judged)


def evaluate(
    df: DataFrame,
    question_col: str,
    answer_col: str,
    make_judge_fn: MakeFn,
    response_col: str | None = None,
    make_fn: MakeFn | None = None,
    make_score_fn: MakeFn | None = None,
    n_samples: int = BEST_OF_N,
    mode: str = "cot",
    batch_size: int = GENERATION_BATCH_SIZE,
    fmt: ChatFormat = CHATML,
    **grading,
) -> DataFrame:
    """Graded rows, of existing responses or of ones made first.

    Without ``response_col`` the model behind ``make_fn`` answers; with
    ``make_score_fn`` too, the best of ``n_samples`` answers is graded.  With
    ``status=True`` the judge's status is kept, and that of the answer too, as
    ``response_status`` and ``response_error``: a failed one is no wrong answer, and
    of several answers all must have failed.
    """
    if response_col is None:
        if make_fn is None:
            raise ValueError("give response_col, or make_fn to make responses")
        response_col = "model_response"
        options = {"output_col": response_col, "mode": mode, "batch_size": batch_size, "fmt": fmt}
        options |= {"status": bool(grading.get("status")), "status_prefix": "response_"}
        require_distinct([*df.columns, response_col, *(["response_status", "response_error"] if grading.get("status") else [])])
        if make_score_fn is None:
            df = execute(df, question_col, make_fn, **options)
        else:
            df = best_of_n_responses(df, question_col, make_fn, make_score_fn, n_samples, **options)
    return grade(df, question_col, response_col, answer_col, make_judge_fn, batch_size=batch_size, fmt=fmt, **grading)


def evaluate_with_metrics(*args, path: str | None = None, **options) -> tuple[DataFrame, dict]:
    """``evaluate``, written to ``path``: the graded rows and their metrics from one run of the models."""
    return write_graded(evaluate(*args, **options), path)


def write_graded(graded: DataFrame, path: str | None = None) -> tuple[DataFrame, dict]:
    """Write graded rows and give them back with their metrics.

    The metrics are summed up while writing: the judge runs once and the rows
    are read by no second job.
    """
    spark = graded.sparkSession
    path = path or scratch_path(spark, "graded")
    seen = Observation()
    graded.observe(seen, *metric_columns(graded)).write.parquet(path)
    return spark.read.schema(graded.schema).parquet(path), seen.get
