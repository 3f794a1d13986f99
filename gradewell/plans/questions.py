"""Question rewriting: requests from source rows, records from model output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.fixed import (
    ANALYSIS_TAG, NEW_QUESTION_TAG, QUESTION_BATCH_SIZE, QUESTION_TEMPLATE, REQUEST_BATCH_SIZE,
    RESERVED_QUESTION_FIELDS,
)
from gradewell.functions.text import clean_text, render, tagged_section
from gradewell.operators.matching import last_wins, match_results
from gradewell.operators.numbering import assign_batches
from gradewell.operators.schema import fresh, quoted, require_columns, require_distinct, text_column
from gradewell.session import materialize

REQUEST_COLUMNS = ("custom_id", "batch_no", "pos")


def question_requests(
    df: DataFrame,
    template: str = QUESTION_TEMPLATE,
    batch_size: int | None = QUESTION_BATCH_SIZE,
    total_samples: int | None = None,
    order_by: list[str] | None = None,
    id_col: str = "id",
    stored_input: bool = False,
    index_col: str | None = None,
) -> DataFrame:
    """One request per row: ids, ``PROMPT`` and every field as text, upper-cased.

    Slots are filled in column order.  ``order_by`` fixes which rows come first,
    and ``total_samples`` needs it or ``index_col``.  For it and
    ``stored_input`` see ``with_row_index``; with the ``index_col`` that
    ``read_numbered`` gives, the rows are not even copied.
    """
    require_columns(df, id_col)
    names = {c: "id" if c == id_col else c.upper() for c in df.columns if c != index_col}
    require_distinct(names.values(), [*RESERVED_QUESTION_FIELDS, *REQUEST_COLUMNS])
    batches = assign_batches(df, batch_size or REQUEST_BATCH_SIZE, order_by, total_samples, stored_input, index_col)
    requests = batches.select(*REQUEST_COLUMNS, *[text_column(df, c).alias(name) for c, name in names.items()])
    return with_prompt(requests, template)


def with_prompt(requests: DataFrame, template: str) -> DataFrame:
    """Adds ``PROMPT``: the template filled with the request's own fields."""
    reserved = (*REQUEST_COLUMNS, *RESERVED_QUESTION_FIELDS)
    fields = [c for c in requests.columns if c not in reserved]
    return requests.withColumn("PROMPT", render(template, {c.upper(): quoted(c) for c in fields}))


def question_parts(output: str = "MODEL_OUTPUT") -> dict[str, Column]:
    """The two tagged parts of the model's text, cleaned; '' where one is missing."""
    return {
        "ANALYSIS": clean_text(tagged_section(output, ANALYSIS_TAG)),
        "FMT_QUESTION": clean_text(tagged_section(output, NEW_QUESTION_TAG)),
    }


def parse_questions(
    requests: DataFrame,
    results: DataFrame | None = None,
    seq: str | None = None,
    template: str | None = None,
    unique_ids: bool = False,
) -> DataFrame:
    """``ANALYSIS, FMT_QUESTION, id, PROMPT`` and the fields, one row per id.

    Rows with a missing part are kept, see ``flag_missing``.  Without
    ``results`` the requests carry ``MODEL_OUTPUT`` themselves.  ``seq`` orders
    several results of one request.  Of several rows with one id the last by
    batch and position stays; ``unique_ids`` spares the steps this takes.

    Only the parts of the output are shuffled.  The prompt holds every field
    once more: with the ``template`` it was made from it is left behind and
    filled in again at the end.
    """
    parts = [c.alias(name) for name, c in question_parts().items()]
    return collect_records(requests, results, parts, seq, template, unique_ids)


def collect_records(
    requests: DataFrame,
    results: DataFrame | None,
    parts: list[Column],
    seq: str | None,
    template: str | None,
    unique_ids: bool,
    fill: Callable[[DataFrame, str], DataFrame] = with_prompt,
) -> DataFrame:
    """The parts of the model's output with the request they answer, one row per id."""
    carried = [c for c in requests.columns if c not in ("MODEL_OUTPUT", "status", "error")]
    if template is not None:
        carried.remove("PROMPT")
    kept = [quoted(c) for c in carried]
    if results is None:
        matched = requests.where("MODEL_OUTPUT IS NOT NULL").select(*kept, *parts)
    else:
        # A result delivered twice is one; without ``seq`` the greater one by its parts.
        order = fresh(requests, "_order")
        found = results.where("MODEL_OUTPUT IS NOT NULL").select(
            "custom_id", *parts, (quoted(seq) if seq else F.lit(0)).alias(order))
        if not unique_ids:
            # The winning request of each id is found on keys alone; wide fields are shuffled once, for winners.
            found = materialize(found, label="parts")
            keys = requests.select("custom_id", "id", "batch_no", "pos").join(found.select("custom_id"), "custom_id")
            last = keys.groupBy("id").agg(F.max_by("custom_id", F.struct("batch_no", "pos")).alias("custom_id"))
            found = found.join(last.select("custom_id"), "custom_id", "left_semi")
        matched = match_results(requests.select(*kept), found, order).drop(order)
    names = [c for c in matched.columns if c not in carried]
    if results is None and not unique_ids:
        matched = last_wins(matched.drop("custom_id"), "id", F.struct("batch_no", "pos"))
    if template is not None:
        matched = fill(matched.drop(*REQUEST_COLUMNS), template)
    fields = [c for c in carried if c not in (*REQUEST_COLUMNS, "id", "PROMPT")]
    return matched.select(*names, "id", "PROMPT", *[quoted(c) for c in fields])


def rewrite_questions(
    df: DataFrame,
    respond: Callable[[DataFrame], DataFrame],
    template: str = QUESTION_TEMPLATE,
    unique_ids: bool = False,
    **options,
) -> DataFrame:
    """From source rows to records: ``respond`` turns the requests into
    ``custom_id, MODEL_OUTPUT``; options are those of ``question_requests``."""
    requests = question_requests(df, template, **options)
    return parse_questions(requests, respond(requests), template=template, unique_ids=unique_ids)


def flag_missing(df: DataFrame) -> DataFrame:
    """Adds ``missing``: the part a record lacks, ``analysis`` before ``question``, or null."""
    return df.withColumn(
        "missing", F.when(F.col("ANALYSIS") == "", F.lit("analysis")).when(F.col("FMT_QUESTION") == "", F.lit("question")))
