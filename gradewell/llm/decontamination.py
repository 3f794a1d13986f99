"""Benchmark items inside documents: size-partitioned MinHash containment, then exact shingles.

An item's sketch is its smallest shingle hashes (bottom-k MinHash).  The share of
a sketch that a document holds estimates how much of the item the document
contains, however long the document is.  Items are partitioned by size: the
smallest are their own sketch and must be found to the threshold, those of the
other SIZES have sketches smaller than themselves and must be found to five
standard errors below it, which loses an item at the threshold less than once in
100,000 times.  What passes is verified on all shingles, as text.  Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.schema import fresh
from gradewell.session import materialize

WORDS = 5
#: Size partitions: most shingles of an item, and hashes of its sketch; beyond the last one, LARGE hashes.
SIZES, LARGE = ((12, 12), (24, 16), (64, 20)), 32


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shifted(column: str) -> list[Column]:
    """The words of ``column`` from each place of a shingle on, as many as there are shingles."""
    n = F.greatest(F.size(column) - (WORDS - 1), F.lit(0))
    return [F.slice(column, F.lit(k + 1), n).alias(f"w{k}") for k in range(WORDS)]


def shingle_hashes(column: str) -> Column:
    """Hashes of all runs of five words."""
    return F.transform(F.arrays_zip(*_shifted(column)), lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(WORDS)]))


def shingles(column: str) -> Column:
    """The distinct runs of five words, as text."""
    return F.array_distinct(
        F.transform(F.arrays_zip(*_shifted(column)), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(WORDS)])))


def sketch_size(n: Column) -> Column:
    """Hashes in the sketch of an item of ``n`` shingles."""
    out = F.lit(LARGE)
    for most, size in reversed(SIZES):
        out = F.when(n <= most, size).otherwise(out)
    return out


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of a document and an item of which it holds ``threshold`` or more of the shingles.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``; other columns are
    not read.  Returns ``doc_id, item_id, n_shared, n_item, containment``.  An
    item with fewer than five words, and a null or empty text on either side, is
    in no pair; nor are rows without an id.  Rows that repeat an id count as one
    document (or item) with the shingles of all of them.  An item in a third of
    all documents is as many rows, nothing more: documents are never paired.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("item_id is not null")
    full = materialize(items.select("item_id", F.explode(shingles("w")).alias("shingle")).distinct(), label="item-shingles")
    sizes = full.groupBy("item_id").agg(F.count("*").alias("n_item"))

    hashed = items.select("item_id", F.explode(F.array_distinct(shingle_hashes("w"))).alias("h")).groupBy("item_id")
    sketch = hashed.agg(F.sort_array(F.collect_set("h")).alias("all")).withColumn("n", F.size("all"))
    sketch = sketch.withColumn("sketch", F.slice("all", F.lit(1), F.least("n", sketch_size(F.col("n")))))
    k = F.size("sketch")
    slack = F.when(F.col("n") > k, 5 * F.sqrt(k * threshold * (1 - threshold))).otherwise(0.0)
    sketch = sketch.select("item_id", F.ceil(k * threshold - slack - 1e-9).alias("needed"), F.explode("sketch").alias("h"))
    sketch = materialize(sketch, label="item-sketches")

    found = docs.select("doc_id", F.explode(shingle_hashes("w")).alias("h")).join(sketch, "h")
    found = found.groupBy("doc_id", "item_id", "needed").agg(F.count_distinct("h").alias("n"))
    likely = materialize(found.where("n >= needed").select("doc_id", "item_id"), label="likely")

    held = docs.join(likely.select("doc_id").distinct(), "doc_id", "left_semi")
    held = held.select("doc_id", F.explode(shingles("w")).alias("shingle")).distinct().join(full, "shingle")
    held = held.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    held = held.join(likely, ["doc_id", "item_id"]).join(sizes, "item_id")
    held = held.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))
    return held.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose id holds an item, columns as they are; rows without an id stay."""
    pairs = materialize(contained_items(docs, items, threshold), label="contaminated")
    name = fresh(docs, "_gone")
    gone = pairs.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
