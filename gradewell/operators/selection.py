"""Samples per question: expansion, grouping and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.schema import quoted, require_columns, require_distinct


def expand_samples(df: DataFrame, n: int) -> DataFrame:
    """Each row ``n`` times with ``sample_no`` 0 to n-1; rows stay where they are."""
    if n < 1:
        raise ValueError("n must be at least 1")
    require_distinct([*df.columns, "sample_no"])
    return df.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _without_nan(score: Column) -> Column:
    """Spark orders NaN above every number; as null it comes last."""
    return F.when(~F.isnan(score.cast("double")), score)


def best_of_n(
    df: DataFrame,
    question_id: str = "question_id",
    response: str = "response",
    score: str = "score",
    sample_no: str = "sample_no",
    keep_unscored: bool = True,
) -> DataFrame:
    """Top-scored response per question; the lowest sample wins a tie.

    NaN counts as no score.  A question without any score gives its first
    sample, or no row with ``keep_unscored=False``.  Only one candidate per
    question and task is shuffled.
    """
    require_columns(df, question_id, response, score, sample_no)
    scored = df.select(
        quoted(question_id),
        F.struct(
            _without_nan(quoted(score)).alias("score"),
            (-quoted(sample_no)).alias("earliest"),
            quoted(response).alias("response"),
        ).alias("_candidate"),
    )
    if not keep_unscored:
        scored = scored.where("_candidate.score IS NOT NULL")
    best = scored.groupBy(quoted(question_id)).agg(F.max("_candidate").alias("_best"))
    return best.select(
        quoted(question_id),
        (-F.col("_best.earliest")).alias(sample_no),
        F.col("_best.response").alias(response),
        F.col("_best.score").alias(score),
    )


def best_candidate(responses: Column, scores: Column) -> Column:
    """The same choice among the candidates of one row, given as two arrays.

    Gives a struct of ``response``, ``score`` and ``sample_no``.
    """
    numbered = F.transform(responses, lambda r, i: F.struct(
        _without_nan(F.get(scores, i)).alias("score"), (-i).alias("earliest"), r.alias("response")))
    best = F.array_max(numbered)
    return F.struct(
        best["response"].alias("response"), best["score"].alias("score"), (-best["earliest"]).alias("sample_no"))


def group_candidates(
    df: DataFrame, n: int, question_id: str = "question_id", response: str = "response", sample_no: str = "sample_no",
) -> DataFrame:
    """The ``n`` responses of each question as one array in sample order.

    A missing sample is null; two rows for one place, or a sample number outside
    0 to n-1, fail the query.  Numbers are checked first, by counts alone, so a
    group that texts are collected for has n rows at most, however many rows
    carry the same question.
    """
    require_columns(df, question_id, response, sample_no)
    rows = df.select(quoted(question_id).alias("question"), quoted(sample_no).alias("number"), quoted(response).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("question"))
    wrong = F.count_if(~F.col("number").between(0, n - 1) | F.col("number").isNull())
    twice = F.greatest(F.lit(0), *[F.count_if(F.col("number") == i) for i in range(n)])
    checked = rows.groupBy("hash", "question").agg(wrong.alias("wrong"), twice.alias("twice"))
    fine = F.when(F.col("wrong") > 0, F.raise_error(F.lit(f"sample number outside 0 to {n - 1}")).cast("boolean"))
    fine = fine.when(F.col("twice") > 1, F.raise_error(F.lit("two rows for one sample number")).cast("boolean")).otherwise(True)
    checked = checked.where(fine).select(F.col("hash").alias("of_hash"), F.col("question").alias("of"))
    same = (F.col("hash") == F.col("of_hash")) & F.col("question").eqNullSafe(F.col("of"))
    texts = rows.join(checked, same).groupBy("hash", "question").agg(
        F.map_from_entries(F.collect_list(F.struct("number", "text"))).alias("texts"))
    at = dict(rows.dtypes)["number"]
    return texts.select(
        F.col("question").alias(question_id), F.array(*[F.try_element_at("texts", F.lit(i).cast(at)) for i in range(n)]).alias("responses"))
