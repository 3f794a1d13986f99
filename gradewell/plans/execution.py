"""Running a model over a question column: one answer, or the best of several."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.fixed import BEST_OF_N, GENERATION_BATCH_SIZE, SYSTEM_MESSAGES
from gradewell.functions.chat import CHATML, ChatFormat, chat_text, system_message
from gradewell.operators.inference import ERROR, SCORE, SUCCESS, MakeFn, model_output
from gradewell.operators.schema import fresh, quoted, require_columns, require_distinct, text_column
from gradewell.operators.selection import best_candidate
from gradewell.session import scratch_path, temporary


def question_text(df: DataFrame, input_col: str, mode: str = "cot", fmt: ChatFormat = CHATML) -> Column:
    """What the model is given: the mode's system message and the question."""
    require_columns(df, input_col)
    return chat_text(text_column(df, input_col), system_message(mode), fmt=fmt)


def execute(
    df: DataFrame,
    input_col: str,
    make_fn: MakeFn,
    output_col: str = "model_response",
    mode: str = "cot",
    batch_size: int = GENERATION_BATCH_SIZE,
    fmt: ChatFormat = CHATML,
    status: bool = False,
    status_prefix: str = "",
    padded: int | None = None,
    length: Callable[[str], int] = len,
) -> DataFrame:
    """``df`` with the model's answer to each row, '' where the model failed.

    The answer stays in its row: no ids, no join and no shuffle.  ``status``
    adds the columns ``status`` and ``error``, with a prefix if given.  For
    ``padded`` and ``length`` see ``model_output``.
    """
    names = [f"{status_prefix}status", f"{status_prefix}error"] if status else []
    require_distinct([*df.columns, *names], [] if output_col in df.columns else [output_col])
    made = fresh(df, "_out")
    answer = model_output(make_fn, question_text(df, input_col, mode, fmt), batch_size, padded=padded, length=length)
    out = df.withColumn(made, answer).withColumn(output_col, F.coalesce(f"{made}.response", F.lit("")))
    if status:
        out = out.withColumns({names[0]: F.col(f"{made}.status"), names[1]: F.col(f"{made}.error")})
    return out.drop(made)


def response_records(df: DataFrame, input_col: str, id_col: str, make_fn: MakeFn, **options) -> DataFrame:
    """``id, question, response, status, error`` for each row."""
    require_columns(df, id_col)
    asked = df.select(quoted(id_col).cast("string").alias("id"), text_column(df, input_col).alias("question"))
    return execute(asked, "question", make_fn, output_col="response", status=True, **options)


def best_of_n_responses(
    df: DataFrame,
    input_col: str,
    make_fn: MakeFn,
    make_score_fn: MakeFn,
    n_samples: int = BEST_OF_N,
    output_col: str = "model_response",
    score_col: str | None = None,
    mode: str = "cot",
    batch_size: int = GENERATION_BATCH_SIZE,
    fmt: ChatFormat = CHATML,
    status: bool = False,
    status_prefix: str = "",
) -> DataFrame:
    """``df`` with the best-scored of ``n_samples`` answers to each row.

    A row's candidates are made, scored and compared in the row itself, so
    nothing is shuffled.  The scorer sees the question with each answer, which
    goes to its worker once a row; failed samples are left unscored and lose
    against any that has a score.  ``status`` adds the columns ``status`` and
    ``error``, with a prefix if given: a row whose samples have all failed is an
    error, with the message of the first.
    """
    names = [f"{status_prefix}status", f"{status_prefix}error"] if status else []
    require_distinct([*df.columns, *names], [] if output_col in df.columns else [output_col])
    asked = question_text(df, input_col, mode, fmt)
    made, scores, best = (fresh(df, c) for c in ("_out", "_scores", "_best"))
    out = df.withColumn(made, model_output(make_fn, asked, batch_size, samples=n_samples))
    opening = chat_text(text_column(df, input_col), SYSTEM_MESSAGES["cot"], fmt=fmt, reply=False)
    before = F.concat(opening, F.lit(fmt.open + "assistant" + fmt.after_role))
    out = out.withColumn(scores, model_output(
        make_score_fn, F.col(f"{made}.response"), batch_size, SCORE, places=n_samples, before=before, after=fmt.close))
    states = F.col(f"{made}.status")
    score = F.zip_with(F.col(f"{scores}.score"), states, lambda s, state: F.when(state == SUCCESS, s))
    out = out.withColumn(best, best_candidate(F.col(f"{made}.response"), score))
    out = out.withColumn(output_col, F.coalesce(f"{best}.response", F.lit("")))
    if score_col:
        out = out.withColumn(score_col, F.col(f"{best}.score"))
    if status:
        made_one = F.array_contains(states, SUCCESS)
        out = out.withColumns({
            names[0]: F.when(made_one, SUCCESS).otherwise(ERROR),
            names[1]: F.when(~made_one, F.get(F.col(f"{made}.error"), F.lit(0)))})
    return out.drop(made, scores, best)


_STORED = "key string, response string, status string, error string"


def execute_stored(
    df: DataFrame,
    input_col: str,
    make_fn: MakeFn,
    store: str,
    model: str,
    output_col: str = "model_response",
    mode: str = "cot",
    batch_size: int = GENERATION_BATCH_SIZE,
    fmt: ChatFormat = CHATML,
    rounds: int = 16,
    sample_no: int = 0,
    **options,
) -> DataFrame:
    """``df`` with the model's answers, of which those under ``store`` are not made again.

    An answer is known by the hash of all that the model is given, the name of the
    ``model`` and the sample number; equal questions are asked once.  What is missing
    is made in ``rounds`` jobs, each of which adds its answers to the store when it
    ends: a run that is stopped loses the round it was in, and the next run goes on
    from there.  Failed answers are made again by the next run.  Adds ``status`` and
    ``error`` of each answer; further ``options`` go to ``model_output``.
    """
    require_distinct([*df.columns, "status", "error"], [] if output_col in df.columns else [output_col])
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    spark = df.sparkSession
    asked = question_text(df, input_col, mode, fmt)
    key = F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(sample_no)), asked), 256)

    def stored() -> DataFrame:
        # An empty part makes the folder readable from the first run on.
        return spark.read.schema(_STORED).parquet(store)

    spark.createDataFrame([], _STORED).write.mode("append").parquet(store)
    with temporary(spark):
        made = stored().where(F.col("status") == SUCCESS).select("key")
        turn = F.pmod(F.xxhash64("key"), F.lit(rounds)).alias("turn")
        todo = df.select(key.alias("key"), asked.alias("asked")).join(made, "key", "left_anti").groupBy("key").agg(F.first("asked").alias("asked"))
        missing = scratch_path(spark, "unanswered")
        todo.select("*", turn).write.partitionBy("turn").parquet(missing)
        for k in range(rounds):
            rest = spark.read.schema("key string, asked string, turn int").parquet(missing).where(F.col("turn") == k)
            answer = rest.select("key", model_output(make_fn, F.col("asked"), batch_size, **options).alias("made"))
            answer.select("key", "made.*").write.mode("append").parquet(store)
    made, answer = fresh(df, "_key"), fresh(df, "_answer")
    best = F.max(F.struct((F.col("status") == SUCCESS).alias("made"), "response", "status", "error")).alias(answer)
    answers = stored().groupBy(F.col("key").alias(made)).agg(best)
    out = df.withColumn(made, key).join(answers, made, "left")
    return out.withColumns({
        output_col: F.coalesce(F.col(f"{answer}.response"), F.lit("")), "status": F.col(f"{answer}.status"), "error": F.col(f"{answer}.error"),
    }).drop(made, answer)
