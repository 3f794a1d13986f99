"""Near-duplicate documents by HyperMinHash registers.

Each of 112 buckets keeps, for the smallest hash of the shingles under its own
permutation, the number of leading zeros and the ten bits that follow: 16 bits a
bucket.  (Every bucket sees every shingle, so that short documents fill all
buckets too.)  Four registers make one band key of 64 bits; two sets with a
Jaccard similarity of 0.8 share none of the 28 keys once in two million times.
Candidates are first judged by the share of equal registers less what different
minima agree in by chance, then by their full sets.

Documents with the same set are one class from the start and appear once in all
that follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import link_in_buckets, open_members
from gradewell.llm.hashing import WORKING_CHARS, mix, pieces, shingle_sets
from gradewell.operators.schema import fresh
from gradewell.session import materialize, temporary

BANDS, ROWS, MANTISSA = 28, 4, 10
BUCKETS = BANDS * ROWS
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 2**64, BUCKETS, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, BUCKETS, np.uint64, endpoint=False)
_SALT = _rng.integers(0, 2**64, BANDS, np.uint64, endpoint=False)
#: Working rows of one step of the minimum.
_CHUNK = 2048
#: Share of equal registers of different minima of equally large sets, in units of 2 ** -MANTISSA.
_CHANCE = 0.7213


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's smallest hash."""
    low = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        low = np.minimum(low, (shingles[i: i + _CHUNK, None] * _MULTIPLY + _ADD).min(axis=0))
    fraction, exponent = np.frexp(low.astype(np.float64))
    mantissa = ((fraction - 0.5) * 2 ** (MANTISSA + 1)).astype(np.int64).clip(0, 2**MANTISSA - 1)
    return (((64 - exponent).clip(0, 63) << MANTISSA) | mantissa).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for every four registers."""
    return mix(np.ascontiguousarray(regs).view("<u8") + _SALT).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers of sets of sizes n and m, corrected for chance agreement."""
    n, m = n.astype(float), m.astype(float)
    chance = _CHANCE * n * m / (n + m) ** 2 / 2**MANTISSA
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


_SIGNATURE = "doc_id long, n_shingles long, set_key binary, band_keys array<long>, registers binary"
_SETS = "doc_id long, n_shingles long, shingles array<long>"


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for part in pieces(texts, WORKING_CHARS):
                sets = shingle_sets(part, size)
                regs = [registers(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(part)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                    pa.array([band_keys(r) if len(s) else None for s, r in zip(sets, regs)], pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ], ["doc_id", "n_shingles", "set_key", "band_keys", "registers"])
                at += len(part)
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for part in pieces(texts, WORKING_CHARS):
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(part)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "shingles"])
                at += len(part)
    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BUCKETS)
                        for c in ("a_regs", "b_regs"))
                n, m = (batch.column(c).to_numpy() for c in ("a_n", "b_n"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b, n, m) >= least))
    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets have ``100 * common >= percent * all``, linked in chains.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are not read.
    Returns one row per row of ``docs`` with an id: ``doc_id, n_shingles,
    component_id`` (smallest id reachable, the own one included) and ``kept``
    (``doc_id = component_id``).

    Null or empty text, or text without words: no shingles, linked with nothing.
    Fewer words than a shingle: the whole sequence is one shingle.  Rows without
    an id are left out.  Rows that repeat an id are returned as often as they
    occur; if their texts differ, a link of one is a link of the id.  An empty
    table gives no rows.
    """
    with temporary(docs.sparkSession) as keep:
        out = keep(_components(docs, shingle_words, percent))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _components(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signatures = materialize(source.mapInArrow(_signatures(shingle_words), _SIGNATURE), label="hyperminhash")
    filled = signatures.where("n_shingles > 0")
    classes = materialize(filled.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), label="classes")
    first = classes.select(F.col("class_id").alias("doc_id"))
    unique = materialize(
        filled.join(first, "doc_id", "left_semi").select("doc_id", "n_shingles", "band_keys", "registers"), label="class-sketches")
    members = open_members(unique.select(F.explode("band_keys").alias("key"), F.col("doc_id").alias("id")))
    wanted = materialize(members.select(F.col("id").alias("doc_id")).distinct(), label="candidates")
    sets = materialize(source.join(wanted, "doc_id").select("doc_id", "text").mapInArrow(_sets(shingle_words), _SETS), label="sets")
    sketches = unique.select("doc_id", F.col("n_shingles"), "registers")

    def side(table: DataFrame, letter: str, **columns: str) -> DataFrame:
        return table.select(F.col("doc_id").alias(letter), *[F.col(c).alias(f"{letter}_{n}") for n, c in columns.items()])

    # Five standard errors below the threshold: the estimate alone loses no link.
    j = percent / 100
    least = j - 5 * (j * (1 - j) / BUCKETS) ** 0.5

    def verify(pairs: DataFrame, _: DataFrame | None) -> DataFrame:
        likely = pairs
        for letter in "ab":
            likely = likely.join(side(sketches, letter, regs="registers", n="n_shingles"), letter)
        likely = likely.select("a", "b", "a_regs", "b_regs", "a_n", "b_n").mapInArrow(_likely(least), "a long, b long")
        likely = materialize(likely, label="likely")
        for letter in "ab":
            likely = likely.join(side(sets, letter, set="shingles", n="n_shingles"), letter)
        common = F.size(F.array_intersect("a_set", "b_set"))
        return likely.where(100 * common >= percent * (F.col("a_n") + F.col("b_n") - common))

    items = sets.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("shingles").alias("items"))
    labels = link_in_buckets(members, verify, lambda _: items, percent)
    groups = classes.join(labels.select(F.col("id").alias("class_id"), "label"), "class_id", "left")
    groups = materialize(groups.select("set_key", F.coalesce("label", "class_id").alias("group_id")), label="groups")
    out = signatures.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    group = F.when(F.col("n_shingles") > 0, F.col("group_id")).otherwise(F.col("doc_id"))
    return materialize(out.select("doc_id", "n_shingles", group.alias("component_id")), label="components")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, columns as they are.

    The row with the smallest id stays; rows without an id all stay, rows that
    repeat an id are one.
    """
    found = near_duplicates(docs, shingle_words, percent).select("doc_id", "kept")
    name = fresh(docs, "_gone")
    gone = found.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    twice = materialize(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name)), label="twice")
    out = docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    if twice.isEmpty():
        return out
    once = out.join(twice, F.col("doc_id") == F.col(name), "left_anti")
    return once.unionByName(out.join(twice, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"]))
