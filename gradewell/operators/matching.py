"""Bringing model results back to the rows they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gradewell.operators.schema import fresh, quoted, require_columns, require_distinct
from gradewell.session import materialize


#: Up to here the places of winning rows (8 bytes each) are broadcast; beyond, Spark chooses the join.
BROADCAST_WINNERS = 500_000


def last_wins(df: DataFrame, key: str | list[str], seq: Column | str, stored_input: bool = False) -> DataFrame:
    """One row per key, the one with the highest ``seq``.

    Each task first keeps its own best row per key, so a key with very many
    rows costs one row per task in the shuffle.  Rows that tie on ``seq`` are
    told apart by their other columns, so the result does not depend on order.

    Where ``df`` is read straight from stored files, ``stored_input`` compares
    keys, ``seq`` and reading places alone and then reads the winning rows by
    their places, so wide columns are neither sorted nor aggregated; of rows that
    tie, the last one read wins.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, *keys, *([seq] if isinstance(seq, str) else []))
    seq = quoted(seq) if isinstance(seq, str) else seq
    if stored_input:
        return _last_read(df, keys, seq)
    rest = [c for c in df.columns if c not in keys]
    best_name = fresh(df, "_best")
    best = df.groupBy(*[quoted(k) for k in keys]).agg(
        F.max(F.struct(seq.alias(fresh(df, "_seq")), *[quoted(c) for c in rest])).alias(best_name))
    return best.select(*[
        quoted(c) if c in keys else F.col(best_name).getField(c).alias(c) for c in df.columns])


def _last_read(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    place = fresh(df, "_place")
    rows = df.withColumn(place, F.monotonically_increasing_id())
    best = F.max(F.struct(seq.alias("seq"), F.col(place).alias("place")))
    winners = rows.groupBy(*[quoted(k) for k in keys]).agg(best.alias("best")).select(F.col("best.place").alias(place))
    seen = Observation()
    winners = materialize(winners.observe(seen, F.count(F.lit(1)).alias("n")), label="winners")
    if seen.get["n"] <= BROADCAST_WINNERS:
        winners = F.broadcast(winners)
    return rows.join(winners, place, "left_semi").drop(place)


def _join_grouped(df: DataFrame, grouped: DataFrame, key: str, how: str) -> DataFrame:
    """Join with a table that was grouped by the same key.

    Such a table would be joined where its groups lie.  Adaptive execution
    splits a hot key only between two shuffles made for the join, so the key's
    hash joins in: the grouped side is shuffled once more, and a key that holds
    very many rows of ``df`` is spread over several tasks.
    """
    hashed = F.xxhash64(quoted(key))
    name = fresh(df, fresh(grouped, "_hash"))
    return df.withColumn(name, hashed).join(grouped.withColumn(name, hashed), [key, name], how).drop(name)


def match_results(requests: DataFrame, results: DataFrame, seq: str | None = None) -> DataFrame:
    """Requests with their results, by ``custom_id``; either alone is dropped.

    Request ids are unique.  Several results of one request would multiply it:
    name the column that orders them as ``seq`` to keep the last one.
    """
    require_columns(requests, "custom_id")
    require_columns(results, "custom_id")
    require_distinct(requests.columns + [c for c in results.columns if c != "custom_id"])
    if seq:
        results = last_wins(results, "custom_id", seq)
    return requests.join(results, "custom_id")


def attach_responses(
    df: DataFrame,
    responses: DataFrame,
    id_col: str = "id",
    response_col: str = "response",
    output_col: str = "model_response",
    seq: str | None = None,
    default: str = "",
) -> DataFrame:
    """Every row of ``df`` with its response, or ``default`` without one.

    Rows that share an id all get the response.  ``seq`` keeps the last of
    several responses to one id; without it ids in ``responses`` must be unique.
    """
    require_columns(df, id_col)
    require_columns(responses, id_col, response_col)
    require_distinct([*df.columns, output_col])
    found = responses.select(quoted(id_col), quoted(response_col).alias(output_col), *([quoted(seq).alias("_order")] if seq else []))
    if seq:
        joined = _join_grouped(df, last_wins(found, id_col, "_order").drop("_order"), id_col, "left")
    else:
        joined = df.join(found, id_col, "left")
    return joined.select(*[quoted(c) for c in df.columns], F.coalesce(quoted(output_col), F.lit(default)).alias(output_col))


def of_ended_batches(results: DataFrame, status: DataFrame) -> DataFrame:
    """Results whose batch has ended, by ``batch_no``; ``status`` is one row per batch."""
    require_columns(results, "batch_no")
    require_columns(status, "batch_no", "ended")
    return _join_grouped(results, status.where("ended").select("batch_no"), "batch_no", "left_semi")


def pair_scores(candidates: DataFrame, scores: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Candidates with scores that arrived apart from them, by question and sample."""
    require_columns(candidates, question_id, "sample_no")
    require_columns(scores, question_id, "sample_no")
    return candidates.join(scores, [question_id, "sample_no"])
