"""Correcting wrong answers: requests from graded rows, corrections from model output."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.fixed import (
    CORRECTED_TAG, FEEDBACK_BATCH_SIZE, FEEDBACK_SLOTS, FEEDBACK_TEMPLATE, REQUEST_BATCH_SIZE,
    RESERVED_FEEDBACK_FIELDS,
)
from gradewell.functions.text import render, tagged_section
from gradewell.operators.numbering import assign_batches
from gradewell.operators.schema import quoted, require_columns, require_distinct, text_column
from gradewell.plans.questions import REQUEST_COLUMNS, collect_records


def feedback_requests(
    df: DataFrame,
    column_mapping: Mapping[str, str] | None = None,
    template: str = FEEDBACK_TEMPLATE,
    batch_size: int | None = FEEDBACK_BATCH_SIZE,
    order_by: list[str] | None = None,
    id_col: str = "id",
    stored_input: bool = False,
) -> DataFrame:
    """One request per wrong answer: ids, ``PROMPT`` and each slot's value, upper-cased.

    ``column_mapping`` names the column of each slot; slots are filled in its order.
    """
    mapping = dict(column_mapping or {slot: slot for slot in FEEDBACK_SLOTS})
    require_columns(df, id_col, *mapping.values())
    require_distinct(["id", *mapping], [*RESERVED_FEEDBACK_FIELDS, *REQUEST_COLUMNS])
    # Only the named columns are sorted and written.
    names = list(dict.fromkeys([id_col, *mapping.values(), *(order_by or [])]))
    narrow = df.select(*[quoted(c) for c in names])
    requests = assign_batches(narrow, batch_size or REQUEST_BATCH_SIZE, order_by, stored_input=stored_input).select(
        *REQUEST_COLUMNS,
        text_column(df, id_col).alias("id"),
        *[text_column(df, column).alias(slot.upper()) for slot, column in mapping.items()],
    )
    return fill_slots(requests, template, mapping)


def fill_slots(requests: DataFrame, template: str, slots: Iterable[str]) -> DataFrame:
    """Adds ``PROMPT``: the template with each slot's upper-cased column."""
    return requests.withColumn("PROMPT", render(template, {slot: quoted(slot.upper()) for slot in slots}))


def parse_feedback(
    requests: DataFrame,
    results: DataFrame | None = None,
    seq: str | None = None,
    template: str | None = None,
    slots: Iterable[str] = FEEDBACK_SLOTS,
    unique_ids: bool = False,
) -> DataFrame:
    """``CORRECTED_RESPONSE, id, PROMPT`` and the slots, one row per id.

    Output without a corrected response is dropped before anything is matched.
    The arguments are those of ``parse_questions``; ``slots`` goes with ``template``.
    """
    # One value or none.  A filter on the extracted text would be pushed below the
    # extraction and extract again.
    corrected = F.explode(F.array_remove(F.array(tagged_section("MODEL_OUTPUT", CORRECTED_TAG)), ""))
    return collect_records(
        requests, results, [corrected.alias("CORRECTED_RESPONSE")], seq, template, unique_ids,
        fill=lambda df, text: fill_slots(df, text, slots),
    )


def correct_answers(
    df: DataFrame,
    respond: Callable[[DataFrame], DataFrame],
    column_mapping: Mapping[str, str] | None = None,
    template: str = FEEDBACK_TEMPLATE,
    unique_ids: bool = False,
    **options,
) -> DataFrame:
    """From wrong answers to corrections: ``respond`` turns the requests into
    ``custom_id, MODEL_OUTPUT``; options are those of ``feedback_requests``."""
    requests = feedback_requests(df, column_mapping, template, **options)
    return parse_feedback(
        requests, respond(requests), template=template, slots=column_mapping or FEEDBACK_SLOTS, unique_ids=unique_ids)


def keep_corrected(df: DataFrame) -> DataFrame:
    """Records that have a corrected response."""
    return df.where(F.col("CORRECTED_RESPONSE") != "")
