"""Running a caller's model over a text column, in batches, inside Spark tasks.

The caller gives a function that loads the model and returns the function to
call; it runs once per Python worker.  Only the text column goes to Python, in
Arrow batches.  A failing batch is tried again in halves, so a bad row costs its own
result, some calls that double with the batch's size once each, and no other result.
"""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.operators.schema import fresh, quoted, require_distinct

MakeFn = Callable[[], Callable[..., Sequence]]

SUCCESS, ERROR = "success", "error"

#: Bytes from which a worker's buffers are returned to the system at once.
LARGE_BUFFER = 1 << 20
_M_MMAP_THRESHOLD = -3

#: Models a Python worker keeps loaded.
MODELS_KEPT = 3

#: Batches' worth of rows from which batches of similar length are made.
POOL = 16

# Output fields of a model: name, type and the value a failed row gets.
TEXT = (("response", T.StringType(), ""),)
SCORE = (("score", T.DoubleType(), None),)
JUDGEMENT = (
    ("response", T.StringType(), ""),
    ("correct_logit", T.DoubleType(), None),
    ("wrong_logit", T.DoubleType(), None),
)


def _number(value) -> float | None:
    """A double; none stands for NaN too."""
    number = None if value is None else float(value)
    return number if number == number else None


def _fields_of(value, fields: Sequence[tuple]) -> tuple:
    """One result as a tuple in the types of the fields."""
    values = (value,) if len(fields) == 1 else tuple(value)
    if len(values) != len(fields):
        raise ValueError(f"model gave {len(values)} values for {len(fields)} fields")
    return tuple(
        _number(v) if isinstance(dtype, T.DoubleType) else v
        for v, (_, dtype, _) in zip(values, fields))


def _call(fn: Callable, fields: Sequence[tuple], *inputs: list) -> list[tuple]:
    """Fields, status and error of each row."""
    rows = len(inputs[0])
    try:
        values = list(fn(*inputs))
        if len(values) != rows:
            raise ValueError(f"model gave {len(values)} results for {rows} rows")
        return [(*_fields_of(v, fields), SUCCESS, None) for v in values]
    except Exception as e:
        if rows == 1:
            return [(*(default for _, _, default in fields), ERROR, str(e))]
        half = rows // 2
        return _call(fn, fields, *(i[:half] for i in inputs)) + _call(fn, fields, *(i[half:] for i in inputs))


def _by_length(texts: list, most: int, padded: int, length: Callable[[str], int]) -> list[list[int]]:
    """Places of texts in batches of similar length: at most ``most``, and at most ``padded`` when all are as long as the longest."""
    sizes = [length(t) if t is not None else 0 for t in texts]
    batches: list[list[int]] = []
    for i in sorted(range(len(texts)), key=sizes.__getitem__):
        if batches and len(batches[-1]) < most and (len(batches[-1]) + 1) * sizes[i] <= padded:
            batches[-1].append(i)
        else:
            batches.append([i])
    return batches


def _struct(rows: list[tuple], schema: pa.StructType, many: int | None) -> pa.Array:
    """Rows as one struct each, or with ``many`` that number of rows as arrays in one struct."""
    columns = []
    for i, field in enumerate(schema):
        values = [row[i] for row in rows]
        if many:
            values = [values[at:at + many] for at in range(0, len(values), many)]
        columns.append(pa.array(values, field.type))
    return pa.StructArray.from_arrays(columns, fields=list(schema))


def _return_large_buffers() -> None:
    """Let what an Arrow batch took go back to the system when the batch is done with.

    Otherwise glibc raises its limit with the first one it frees, and later batches
    leave holes in the heap: a worker then holds several times a batch.
    """
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None) if sys.platform == "linux" else None
    if mallopt is not None:
        mallopt(_M_MMAP_THRESHOLD, LARGE_BUFFER)


def _loaded(name: str, make_fn: MakeFn) -> Callable:
    """The model this worker has loaded under ``name``; it keeps the last MODELS_KEPT.

    They hang on a module of the worker itself: what travels with a task goes with it.
    """
    if "gradewell_models" not in sys.modules:
        _return_large_buffers()
    kept = sys.modules.setdefault("gradewell_models", types.ModuleType("gradewell_models")).__dict__.setdefault("kept", {})
    kept[name] = kept.pop(name) if name in kept else make_fn()
    while len(kept) > MODELS_KEPT:
        del kept[next(iter(kept))]
    return kept[name]


def model_output(
    make_fn: MakeFn,
    text: Column,
    batch_size: int,
    fields: Sequence[tuple] = TEXT,
    samples: int | None = None,
    places: int | None = None,
    padded: int | None = None,
    length: Callable[[str], int] = len,
    before: Column | None = None,
    after: str = "",
) -> Column:
    """Struct of the model's fields plus ``status`` and ``error``.

    With ``samples`` each text is given that often, and the model gets the
    sample numbers as its second argument, to seed each draw: a task run again
    after a lost executor then draws the same.  With ``places`` the column is an
    array of that many texts.  In both cases every field is an array.

    ``before``, with ``places``, is text that stands before each of the row's texts,
    and ``after`` text behind them: sent once a row, put together in the worker.

    A model pads a batch to its longest text.  With ``padded`` batches are made of
    texts of similar ``length`` instead of neighbours, POOL batches' worth at a
    time, so that rows times the longest length stay within it; a longer text goes
    alone.  Results come back in the order of the rows all the same.  The
    result is marked as not repeatable: write it before using it twice.
    """
    if before is not None and not places:
        raise ValueError("before needs places")
    if batch_size < 1 or (padded is not None and padded < 1):
        raise ValueError("batch_size and padded must be at least 1")

    name, many = uuid.uuid4().hex, samples or places
    step = batch_size * (POOL if padded else 1)
    wrap = pa.list_ if many else (lambda t: t)
    kinds = [pa.float64() if isinstance(dtype, T.DoubleType) else pa.string() for _, dtype, _ in fields] + [pa.string()] * 2
    names = [field for field, *_ in fields] + ["status", "error"]
    arrow = pa.struct([pa.field(n, wrap(kind)) for n, kind in zip(names, kinds)])

    def results(fn: Callable, texts: list, heads: list | None) -> list[tuple]:
        if places:
            if any(row is None or len(row) != places for row in texts):
                raise ValueError(f"a row has not {places} texts")
            texts = [t for row in texts for t in row]
        if heads is not None:
            given = zip([head for head in heads for _ in range(places)], texts)
            texts = [None if head is None or text is None else head + text + after for head, text in given]
        inputs = [texts]
        if samples:
            inputs = [[t for t in texts for _ in range(samples)], list(range(samples)) * len(texts)]
        if padded:
            out: list = [None] * len(inputs[0])
            for batch in _by_length(inputs[0], batch_size, padded, length):
                for i, result in zip(batch, _call(fn, fields, *([column[i] for i in batch] for column in inputs))):
                    out[i] = result
            return out
        out = []
        for start in range(0, len(inputs[0]), batch_size):
            out += _call(fn, fields, *(i[start:start + batch_size] for i in inputs))
        return out

    # Texts stay in Arrow until their turn: as Python's they are never more than one step of them.
    def stepwise(columns: Sequence[pa.Array]) -> Iterator[pa.Array]:
        fn = _loaded(name, make_fn)
        for at in range(0, len(columns[0]), step):
            texts, *heads = (column.slice(at, step).to_pylist() for column in columns)
            yield _struct(results(fn, texts, heads[0] if heads else None), arrow, many)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from stepwise([batch])

    def two(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from stepwise(batch)

    extra = [("status", T.StringType()), ("error", T.StringType())]
    schema = T.StructType([T.StructField(n, T.ArrayType(t) if many else t) for n, t in [f[:2] for f in fields] + extra])
    columns = [text] if before is None else [text, before]
    return F.arrow_udf(one if before is None else two, schema).asNondeterministic()(*columns)


def answer_requests(requests: DataFrame, make_fn: MakeFn, batch_size: int, prompt: str = "PROMPT") -> DataFrame:
    """Requests with ``MODEL_OUTPUT``, ``status`` and ``error`` from a model run here.

    The output stays in its row: no custom id has to be matched.
    """
    require_distinct([*requests.columns, "MODEL_OUTPUT", "status", "error"])
    made = fresh(requests, "_out")
    out = requests.withColumn(made, model_output(make_fn, quoted(prompt), batch_size))
    return out.select(
        *[quoted(c) for c in requests.columns],
        F.when(F.col(f"{made}.status") == SUCCESS, F.col(f"{made}.response")).alias("MODEL_OUTPUT"),
        f"{made}.status",
        f"{made}.error",
    )
