import math

import pytest
from pyspark.sql import functions as F

from gradewell.fixed import JUDGE_SYSTEM_MESSAGE, SYSTEM_MESSAGES
from gradewell.functions.chat import (
    ChatFormat, chat, chat_text, judge_chat_text, judge_prompt, render_chat, system_message,
)
from gradewell.functions.verdict import (
    confidence_from_logits, confidence_from_probabilities, is_correct, mean_score,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_modes():
    assert system_message("cot") == SYSTEM_MESSAGES["cot"] != system_message("tir")
    with pytest.raises(ValueError, match="unknown mode"):
        system_message("other")


def test_chat_text(spark):
    fmt = ChatFormat("[", ":", "]", "[assistant:")
    user, answer = F.lit("q"), F.lit("a")
    assert one(spark, chat_text(user, "s", fmt=fmt)) == "[system:s][user:q][assistant:"
    assert one(spark, chat_text(user, "s", answer, fmt, reply=False)) == "[system:s][user:q][assistant:a]"
    assert one(spark, render_chat(chat(user, "s", answer), fmt, reply=False)) == "[system:s][user:q][assistant:a]"
    assert one(spark, render_chat(chat(user), fmt)) == "[user:q][assistant:"
    assert one(spark, chat_text(user)) == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"


def test_judge_prompt(spark):
    missing = F.lit(None).cast("string")
    prompt = one(spark, judge_prompt(F.lit("2+2? {{correct_answer}}"), missing, F.lit("4")))
    assert prompt == (
        "\nQuestion:\n2+2? {{correct_answer}}\n\nStudent's Answer:\nNone\n\nCorrect Answer:\n4\n\n"
        "Is the student's final answer correct? Respond with either 'Correct' or 'Wrong'.\n")
    text = one(spark, judge_chat_text(F.lit("q"), missing, F.lit("4")))
    assert text.startswith(f"<|im_start|>system\n{JUDGE_SYSTEM_MESSAGE}<|im_end|>\n<|im_start|>user\n\nQuestion:")
    assert "be kind" in one(spark, judge_chat_text(F.lit("q"), missing, F.lit("4"), "be kind"))


VERDICTS = [  # text, strict, contains
    ("Correct", True, True), ("CORRECT!", True, True), ("The answer is correct.", True, True),
    ("Incorrect", False, True), ("not correct", False, True), ("correctness", False, True),
    ("Correct? Wrong.", False, True), ("Wrong", False, False), ("", False, False), (None, None, None),
]


@pytest.mark.parametrize("place,rule", [(1, "strict"), (2, "contains")])
def test_verdicts(spark, place, rule):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VERDICTS)], "i int, v string")
    got = [r.x for r in df.select("i", is_correct("v", rule).alias("x")).orderBy("i").collect()]
    assert got == [v[place] for v in VERDICTS]
    with pytest.raises(ValueError, match="unknown rule"):
        is_correct("v", "other")


@pytest.mark.parametrize("correct,wrong,want", [
    (-800.0, 800.0, 0.0), (0.0, 0.0, 0.5), (800.0, -800.0, 1.0), (None, 1.0, 0.5),
    (math.inf, math.inf, 0.5), (1.0, 0.0, math.e / (math.e + 1))])
def test_confidence_from_logits(spark, correct, wrong, want):
    pair = [F.lit(v).cast("double") for v in (correct, wrong)]
    assert one(spark, confidence_from_logits(*pair)) == pytest.approx(want, abs=1e-12)


def test_confidence_from_probabilities(spark):
    assert one(spark, confidence_from_probabilities(F.lit(0.0), F.lit(0.0))) == 0.5
    assert one(spark, confidence_from_probabilities(F.lit(0.6), F.lit(0.2))) == pytest.approx(0.75)
    assert one(spark, confidence_from_probabilities(F.lit(None), F.lit(0.2))) == 0.5


def test_mean_score(spark):
    def mean(values):
        return one(spark, mean_score(F.lit(values).cast("array<float>") if values is None else
                                     F.array(*[F.lit(v) for v in values]).cast("array<double>")))

    assert mean([1.0, 2.0]) == 1.5
    assert mean([]) is None
    assert mean(None) is None
