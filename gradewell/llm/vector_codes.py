"""Vectors compressed to one code a part, with LAESA pivots in the search for the nearest entry.

A vector of whole numbers is cut into equal consecutive parts, each with a codebook
of its own.  Some entries of the first codebook, far from each other, are the
fixed pivots of a part: every part's distances to them are computed once and
stored beside the vector.  In each round only the entries' distances to the pivots
are new.  ``|d(part, pivot) - d(entry, pivot)|`` is a lower bound of the distance
between part and entry; entries are tried by ascending bound with exact integer
distances until a bound is above the best distance so far.  Bounds get slack for
their rounding, so codes are those of a full search, ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.vectors import matrix, whole_vectors
from gradewell.session import materialize

PIVOTS = 4
#: Rows worked on at once.
_CHUNK = 4096
#: Beyond it squares of differences, summed up, do not surely fit 64 bits: Python's integers take over.
_LARGE = 2**27
#: Relative rounding of distances stored in 32 bits, with room to spare.
_SLACK = np.float32(4e-7)
_BIG = 2**200


def _numbers(a: np.ndarray, large: bool) -> np.ndarray:
    return a.astype(object) if large else a


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded distances of all rows of ``a`` to all of ``b``."""
    d = a[:, None, :].astype(np.float64) - b[None, :, :].astype(np.float64)
    return np.sqrt((d * d).sum(axis=2)).astype(np.float32)


def choose_pivots(entries: np.ndarray) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen."""
    chosen = [0]
    while len(chosen) < min(PIVOTS, len(entries)):
        chosen.append(int(distances(entries, entries[chosen]).min(axis=1).argmax()))
    return entries[chosen]


def nearest(rows: np.ndarray, near: np.ndarray, entries: np.ndarray, entry_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry, exact squared distances, and how many distances were evaluated.

    ``near``, ``entry_near``: distances of rows and entries to the same pivots.
    """
    large = max(abs(int(rows.max())), abs(int(rows.min())), abs(int(entries.max())), abs(int(entries.min()))) >= _LARGE
    rows, entries = _numbers(rows, large), _numbers(entries, large)
    low = np.zeros((len(rows), len(entries)), np.float32)
    for p in range(near.shape[1]):
        a, b = near[:, p, None], entry_near[None, :, p]
        np.maximum(low, np.abs(a - b) - _SLACK * (a + b), out=low)
    order = np.argsort(low, axis=1)
    low = np.take_along_axis(low, order, axis=1)
    code = np.zeros(len(rows), np.int64)
    best = np.full(len(rows), _BIG, object) if large else np.full(len(rows), np.iinfo(np.int64).max)
    reach = np.full(len(rows), np.inf)
    alive, evaluated = np.arange(len(rows)), 0
    for k in range(len(entries)):
        alive = alive[low[alive, k] <= reach[alive]]
        if not len(alive):
            break
        e = order[alive, k]
        d = rows[alive] - entries[e]
        d = (d * d).sum(axis=1)
        evaluated += len(alive)
        better = (d < best[alive]) | ((d == best[alive]) & (e < code[alive]))
        at = alive[better]
        best[at], code[at] = d[better], e[better]
        reach[at] = np.sqrt(d[better].astype(np.float64)) * (1 + 1e-6) + 1e-6
    return code, best, evaluated


class Search:
    """Nearest entries of whole vectors by parts: codebooks (part, entry, place) and pivots (part, pivot, place)."""

    def __init__(self, codebooks: np.ndarray, pivots: np.ndarray):
        self.codebooks = codebooks
        self.entry_near = [distances(c, p) for c, p in zip(codebooks, pivots)]

    def __call__(self, x: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of parts (row, part, place), their codes and squared distances (row, part)."""
        parts, _, size = self.codebooks.shape
        for at in range(0, len(x), _CHUNK):
            cut = x[at: at + _CHUNK].reshape(-1, parts, size)
            own = near[at: at + _CHUNK].reshape(-1, parts, near.shape[1] // parts)
            found = [nearest(cut[:, m], own[:, m], self.codebooks[m], self.entry_near[m]) for m in range(parts)]
            yield cut, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _with_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, size = pivots.shape
        for batch in batches:
            x = matrix(batch.column("x"), parts * size).reshape(-1, parts, size)
            near = np.concatenate([distances(x[:, m], pivots[m]) for m in range(parts)], axis=1)
            near = pa.array([r.tobytes() for r in near], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, near], [*batch.schema.names, "near"])
    return run


def _inputs(batch: pa.RecordBatch, dims: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float32).reshape(-1, width)
    return matrix(batch.column("x"), dims), near


_SUMS = "part int, code int, n long, sums array<decimal(38,0)>"
_DECIMALS = pa.list_(pa.decimal128(38, 0))


def _entry_sums(codebooks: np.ndarray, pivots: np.ndarray):
    """Per task and entry: how many parts it is nearest to, and their sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = codebooks.shape
        search, n = Search(codebooks, pivots), np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, size), object)
        for batch in batches:
            for cut, code, _ in search(*_inputs(batch, parts * size, parts * pivots.shape[1])):
                large = np.abs(cut).max() >= 2**62 // _CHUNK
                for m in range(parts):
                    order = np.argsort(code[:, m], kind="stable")
                    own = code[order, m]
                    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    sums[m, own[starts]] += np.add.reduceat(_numbers(cut[order, m], large), starts, axis=0).astype(object)
                    n[m] += np.bincount(code[:, m], minlength=entries)
        m, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(m.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[m, e]),
            pa.array([[_decimal(v) for v in sums[i, j]] for i, j in zip(m, e)], _DECIMALS)], ["part", "code", "n", "sums"])
    return run


def _decimal(v: int):
    from decimal import Decimal
    return Decimal(int(v))


def _codes(codebooks: np.ndarray, pivots: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, size = codebooks.shape
        search = Search(codebooks, pivots)
        for batch in batches:
            texts, errors = [], []
            for _, code, error in search(*_inputs(batch, parts * size, parts * pivots.shape[1])):
                text = code.astype(np.uint8).tobytes().hex()
                texts += [text[i: i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                errors += [_decimal(v) for v in error.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(texts, pa.string()), pa.array(errors, pa.decimal128(38, 0))], [*columns, "code", "error"])
    return run


def compress(rows: DataFrame, *keep: str, vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Codes of all whole vectors, and the codebooks (part, entry, place).

    ``keep``: columns to return beside ``code`` (two hex digits a part) and
    ``error`` (exact squared distances, summed; a decimal), the first of them the
    id.  Codebooks start as the parts of the vectors with the ``entries`` smallest
    ids (the least vector of an id that repeats; rows without an id give none);
    each round replaces an entry by the floored mean of the parts it is nearest to.

    Vectors that are null, hold null or non-finite components or have another
    length than that of the smallest id are left out.  A length that ``parts`` does
    not divide is filled with zeros, which change no distance.  No vector, or none
    with an id: no rows, codebooks without entries.  At most ``entries`` times
    ``parts`` sums reach the driver, whatever the number of rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    whole, _, dims = whole_vectors(rows, vector, *keep)
    schema = whole.drop("x").withColumn("code", F.lit("")).withColumn("error", F.lit(None).cast("decimal(38,0)")).schema
    size = -(-dims // parts) if dims else 1
    fill = parts * size - dims
    if fill:
        whole = whole.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), fill)))
    ids = [r[0] for r in whole.where(F.col(keep[0]).isNotNull()).select(keep[0]).distinct().orderBy(keep[0]).limit(entries).collect()]
    if not ids:
        return whole.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, size), np.int64)
    first = whole.where(F.col(keep[0]).isin(ids)).groupBy(keep[0]).agg(F.min("x").alias("x")).orderBy(keep[0]).collect()
    codebooks = np.array([r["x"] for r in first], np.int64).reshape(-1, parts, size).transpose(1, 0, 2).copy()
    pivots = np.stack([choose_pivots(c) for c in codebooks])
    whole = materialize(whole.mapInArrow(_with_pivots(pivots), whole.withColumn("near", F.lit(b"")).schema), label="pivot-distances")
    for _ in range(rounds):
        sums = whole.select("x", "near").mapInArrow(_entry_sums(codebooks, pivots), _SUMS)
        sums = sums.groupBy("part", "code").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)])
        codebooks = codebooks.copy()
        for r in sums.collect():
            codebooks[r["part"], r["code"]] = [int(r[f"s{k}"]) // r["n"] for k in range(size)]
    return whole.mapInArrow(_codes(codebooks, pivots, list(keep)), schema), codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for v in codebooks.reshape(-1).tolist()).encode()).hexdigest()


def code_report(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of all whole vectors in ``embedding``.

    ``label_error`` sums up ``error`` over rows with an equal ``label``, nulls
    together.  An error that no long holds is null.  Other columns are not read.
    """
    codes, codebooks = compress(rows, "vec_id", "label", parts=parts, entries=entries, rounds=rounds)
    codes = materialize(codes, label="codes")
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), label="label-errors")
    sums = sums.withColumnRenamed("label", "of_label")
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    digest = codebooks_digest(codebooks)
    return out.select("vec_id", "code", F.expr("try_cast(error as bigint)").alias("error"),
                      F.expr("try_cast(label_error as bigint)").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
