"""Preference triples from corrected and rejected responses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.fixed import FEEDBACK_BATCH_SIZE, FEEDBACK_TEMPLATE
from gradewell.functions.chat import CHATML, ChatFormat, chat_text, system_message
from gradewell.operators.grading import wrong_answers
from gradewell.operators.inference import ERROR
from gradewell.operators.schema import quoted, require_columns, text_column
from gradewell.plans.feedback import correct_answers


def preference_pairs(
    df: DataFrame,
    question_col: str = "QUESTION",
    chosen_col: str = "CORRECTED_RESPONSE",
    rejected_col: str = "AI_RESPONSE",
    mode: str = "cot",
    null_policy: str = "drop",
    fmt: ChatFormat = CHATML,
) -> DataFrame:
    """``prompt, chosen, rejected`` for each row.

    Rows without a chosen or rejected text are dropped, or with
    ``null_policy="text"`` kept with the text ``None``.
    """
    if df is None:
        raise ValueError("no rows given to make preference triples from")
    require_columns(df, question_col, chosen_col, rejected_col)
    if null_policy not in ("drop", "text"):
        raise ValueError("null_policy is 'drop' or 'text'")
    if null_policy == "drop":
        df = df.where(quoted(chosen_col).isNotNull() & quoted(rejected_col).isNotNull())
    return df.select(
        chat_text(text_column(df, question_col), system_message(mode), fmt=fmt).alias("prompt"),
        text_column(df, chosen_col).alias("chosen"),
        text_column(df, rejected_col).alias("rejected"),
    )


def preference_set(
    graded: DataFrame,
    respond: Callable[[DataFrame], DataFrame],
    id_col: str,
    question_col: str,
    answer_col: str,
    response_col: str,
    mode: str = "cot",
    batch_size: int = FEEDBACK_BATCH_SIZE,
    order_by: list[str] | None = None,
    template: str = FEEDBACK_TEMPLATE,
    unique_ids: bool = False,
    null_policy: str = "drop",
) -> DataFrame:
    """From graded answers to preference triples.

    Wrong answers become correction requests, ``respond`` turns the requests
    into ``custom_id, MODEL_OUTPUT``, and the corrections are paired with the
    responses they correct.  Without ``order_by`` the graded rows are evaluated
    just once, when the numbered requests are stored.

    Only answers found wrong are corrected: where the judge or the model failed
    (``judge_status``, ``response_status`` or ``status`` is an error) nothing is known, and an
    empty response is nothing to reject.  Rows without a response are dropped
    too, unless ``null_policy="text"`` keeps them with the text ``None``.
    """
    wrong = wrong_answers(graded)
    for name in ("judge_status", "response_status", "status"):
        if name in graded.columns:
            wrong = wrong.where(F.coalesce(quoted(name) != ERROR, F.lit(True)))
    response = quoted(response_col).cast("string")
    wrong = wrong.where((response != "") | response.isNull() if null_policy == "text" else response != "")
    mapping = {
        "question": question_col,
        "answer": answer_col,
        "cot_response": response_col,
        "extracted_answer": "extracted_answer",
    }
    feedback = correct_answers(
        wrong, respond, mapping, template, unique_ids,
        batch_size=batch_size, order_by=order_by, id_col=id_col)
    return preference_pairs(feedback.withColumn("AI_RESPONSE", F.col("COT_RESPONSE")), mode=mode, null_policy=null_policy)
