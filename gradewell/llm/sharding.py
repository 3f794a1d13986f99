"""Contiguous shards of nearly equal size, by global prefix sums of bytes.

Rows are put in one order by the hash of their text, so that equal texts are
neighbours; each partition of that order gives its total, the totals' prefix sums
give every row its place among all bytes, and the shards are cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.session import materialize

_PLACE_BITS = 33
#: Rows with equal texts stay in one shard where together they are at most this part of a shard.
WHOLE_GROUP = 0.01


def shards(docs: DataFrame, count: int = 8, group: Column | None = None) -> DataFrame:
    """``docs`` (``doc_id, text``) in ``count`` shards of nearly equal bytes.

    A row's size is the bytes of its text (null: none) plus one.  The shard is
    where the middle of the row lies among all bytes; rows with equal texts, if
    few, go by the middle of all of them together.  A row is never split, so a
    shard is off by half a row at each end, or half of such a group.

    Returns ``doc_id, size, text_crc32`` (unsigned; zero for null and empty),
    ``law`` (``bytes``), ``shard, slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (null).  Null ids and repeated rows are rows like others; an
    empty table gives no rows.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = materialize(rows, label="sizes")
    same = ["text_hash", "text_crc32", "size"]
    order = [*same, "doc_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), label="ordered")
    part = F.shiftrightunsigned("place", _PLACE_BITS)
    totals = ordered.groupBy(part.alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per partition, not per document.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")], "bytes")
    starts = materialize(starts, label="starts")
    total = starts.agg(F.max(F.col("bytes_before") + F.col("bytes"))).first()[0]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("part", part)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts.drop("bytes"), "part").select(
        *order, (F.col("start") + F.col("bytes_before")).alias("start"),
        (F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("rows_before")).alias("row"))
    placed = materialize(placed, label="placed")
    groups = placed.groupBy(*same).agg(F.min("start").alias("group_start"), F.count("*").alias("n"))
    # Sizes of equal texts are equal; groups too large for one shard are cut between rows.
    groups = groups.where((F.col("n") > 1) & (F.col("n") * F.col("size") * count <= WHOLE_GROUP * total))
    groups = materialize(groups.select(*same, "group_start", (F.col("n") * F.col("size")).alias("group_bytes")), label="groups")
    out = placed.join(groups, same, "left")
    twice = F.coalesce(2 * F.col("group_start") + F.col("group_bytes"), 2 * F.col("start") + F.col("size"))
    shard = F.least(F.lit(count - 1), F.floor(twice.cast("decimal(38,0)") * count / (2 * total)).cast("int"))
    out = materialize(out.select("doc_id", "size", "text_crc32", "row", shard.alias("shard")), label="shards")
    firsts = out.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return out.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
