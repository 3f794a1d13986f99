"""Column functions that turn a judge's or scorer's output into numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.fixed import NEUTRAL_CONFIDENCE

RULES = ("strict", "contains")


def is_correct(evaluation: Column | str, rule: str = "strict") -> Column:
    """Whether the judge's text calls the answer correct.

    ``contains`` looks for the letters "correct" anywhere, so "Incorrect"
    passes too.  ``strict`` wants the whole word and none of "incorrect",
    "wrong" or "not correct".  Null stays null.
    """
    text = F.lower(F.col(evaluation) if isinstance(evaluation, str) else evaluation)
    if rule == "contains":
        return text.contains("correct")
    if rule == "strict":
        return text.rlike(r"\bcorrect\b") & ~text.rlike(r"\b(?:incorrect|wrong|not correct)\b")
    raise ValueError(f"unknown rule {rule!r}, choose from {RULES}")


def confidence_from_logits(correct: Column, wrong: Column) -> Column:
    """Two-way softmax: the share of "correct" against "wrong"."""
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(wrong.cast("double") - correct.cast("double")))
    return F.coalesce(F.nanvl(share, F.lit(NEUTRAL_CONFIDENCE)), F.lit(NEUTRAL_CONFIDENCE))


def confidence_from_probabilities(correct: Column, wrong: Column) -> Column:
    """The same share from two probabilities; neutral when both are zero or one is missing."""
    total = correct.cast("double") + wrong.cast("double")
    return F.coalesce(F.try_divide(correct.cast("double"), total), F.lit(NEUTRAL_CONFIDENCE))


def mean_score(values: Column | str) -> Column:
    """Mean of an array of scores; null for an empty or null array."""
    values = (F.col(values) if isinstance(values, str) else values).cast("array<double>")
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values).cast("double"))
