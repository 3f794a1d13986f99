"""Rows of numbers with equal keys brought together, many of them in one Spark row.

Where nearly all keys are unique, most of a job's time goes into single rows: to
shuffle, count, sort and join them.  Here a task deals its rows out to shares of the
keys and hands on one row for each share; Spark groups the shares, and a function
looks at all rows of one share at a time, as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradewell.llm.hashing import mix

#: Rows that a task holds before it deals them out.
HELD_ROWS = 500_000
#: Shares of the keys for each of the session's shuffle partitions: a task's memory goes with one share.
SHARES = 4


def by_key(df: DataFrame, columns: list[str], group: Callable[..., pa.Table], schema: str,
           rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """What ``group`` makes of each share of the rows; rows with equal keys are in one share.

    ``columns``: longs without nulls, the first is the key; ``rows``, if given, makes
    them of the batches of ``df`` in the same task.  ``group`` gets one array for each
    column, in no order, and returns a table with ``schema``.
    """
    shares = SHARES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"c{k}" for k in range(len(columns))]
    dealt = (df if rows else df.select(*columns)).mapInArrow(_deal(rows, names, shares), "share int, " + ", ".join(f"{n} binary" for n in names))

    def whole(table: pa.Table) -> pa.Table:
        return group(*[np.frombuffer(b"".join(table.column(n).to_pylist()), np.int64) for n in names])

    return dealt.groupBy("share").applyInArrow(whole, schema)


def _deal(rows, names: list[str], shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in rows(batches) if rows else batches:
            # Slices, as one batch may hold more than is dealt out at once.
            for at in range(0, batch.num_rows, HELD_ROWS):
                part = batch.slice(at, HELD_ROWS)
                held.append([c.to_numpy() for c in part.columns])
                n += part.num_rows
                if n >= HELD_ROWS:
                    yield _shares(held, names, shares)
                    held, n = [], 0
        if n:
            yield _shares(held, names, shares)
    return run


def _shares(held: list[list[np.ndarray]], names: list[str], shares: int) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held)]
    share = (mix(columns[0].view(np.uint64)) % np.uint64(shares)).astype(np.uint16 if shares < 2**16 else np.uint32)
    order = np.argsort(share, kind="stable")
    sizes = np.bincount(share, minlength=shares)
    there = np.flatnonzero(sizes)
    ends = pa.py_buffer(np.append(0, np.cumsum(sizes[there]) * 8).astype(np.int32))
    packed = [pa.Array.from_buffers(pa.binary(), len(there), [None, ends, pa.py_buffer(c[order])]) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *packed], ["share", *names])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Places of keys that come more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    return order[np.append(False, same) | np.append(same, False)] if len(keys) else order


def starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out
