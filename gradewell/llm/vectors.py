"""Vectors as whole numbers, and sums of task results in levels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import stored_with
from gradewell.session import materialize

#: Task results combined at once.
FAN_IN = 16


def whole_vectors(rows: DataFrame, vector: str, *keep: str, scale: int = 256) -> tuple[DataFrame, int, int]:
    """Stored rows ``*keep, x`` with ``x = floor(scale * component)``, their number, and the number of dimensions.

    Left out are rows whose vector is null or holds null or non-finite components,
    components beyond 2**62 / ``scale`` (no long), and vectors of another length
    than that of the row with the smallest first kept column.
    """
    c = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**62 / scale))
    kept = rows.select(*[F.col(f"`{k}`").alias(k) for k in keep], c.alias("x"))
    kept = kept.where(F.coalesce(whole, F.lit(False)))
    kept = kept.withColumn("x", F.transform("x", lambda v: F.floor(v * scale)))
    size = F.struct(F.col(keep[0]).isNull().alias("none"), F.col(keep[0]).alias("id"), F.size("x").alias("n"))
    kept, seen = stored_with(kept, "whole-vectors", n=F.count(F.lit(1)), first=F.min(size), lo=F.min(F.size("x")), hi=F.max(F.size("x")))
    if not seen["n"]:
        return kept, 0, 0
    dims, n = seen["first"]["n"], seen["n"]
    if seen["lo"] != seen["hi"]:
        kept = kept.where(F.size("x") == dims)
        n = kept.count()
    return kept, n, dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def combined(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """All task results ``part long, payload binary`` made one, FAN_IN at a time in stored levels.

    A group holds FAN_IN payloads at most, and only the last one reaches the
    driver; a lost executor costs the groups of one level.  No rows: none.
    """
    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        return pd.DataFrame({"part": [group["part"].iloc[0] // FAN_IN], "payload": [merge(list(group["payload"]))]})

    parts, seen = stored_with(parts, "task-results", n=F.count(F.lit(1)), hi=F.max("part"))
    if not seen["n"]:
        return None
    top = seen["hi"]
    while True:
        level = parts.groupBy((F.col("part") / FAN_IN).cast("long").alias("group")).applyInPandas(together, "part long, payload binary")
        if top < FAN_IN:
            return bytes(level.first()["payload"])
        parts, top = materialize(level, label="task-results"), top // FAN_IN
