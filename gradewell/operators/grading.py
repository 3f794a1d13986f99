"""Metrics of graded answers and of request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.fixed import REQUEST_STATES
from gradewell.operators.schema import require_columns


def metric_columns(df: DataFrame) -> list[Column]:
    """Accuracy, counts and mean confidence as aggregates over graded rows.

    Usable in ``agg`` and in ``observe``.  Without rows the means are null;
    without a confidence column its mean is null.
    """
    require_columns(df, "is_correct")
    correct = F.coalesce(F.col("is_correct"), F.lit(False))
    confidence = F.avg("confidence_score") if "confidence_score" in df.columns else F.max(F.lit(None).cast("double"))
    return [
        F.avg(correct.cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(correct).alias("correct_samples"),
        confidence.alias("average_confidence"),
    ]


def metrics(df: DataFrame) -> DataFrame:
    """One row of metrics over graded rows."""
    return df.agg(*metric_columns(df))


def batch_status(df: DataFrame, state: str = "status") -> DataFrame:
    """Requests per state and batch, and whether the batch has ended.

    A batch has ended once all its requests have a final state; errors are
    counted apart and do not keep it open.  A null state, or one that is not
    known, counts as ``n_other`` and does: nothing says that it is final.
    """
    require_columns(df, "batch_no", state)
    counts = [F.count_if(F.col(state) == s).alias(f"n_{s}") for s in REQUEST_STATES]
    other = F.count_if(~F.coalesce(F.col(state).isin(*REQUEST_STATES), F.lit(False))).alias("n_other")
    return df.groupBy("batch_no").agg(*counts, other).withColumn("ended", (F.col("n_processing") + F.col("n_other")) == 0)


def wrong_answers(df: DataFrame) -> DataFrame:
    """Graded rows that were not found correct."""
    require_columns(df, "is_correct")
    return df.where(~F.coalesce(F.col("is_correct"), F.lit(False)))
