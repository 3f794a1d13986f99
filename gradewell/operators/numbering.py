"""Dense row numbers and what is cut from them: ids, batches and sample limits.

A window over the whole table would put every row into one task.  Instead the
rows are sorted by range into one table in the shared scratch folder, each row
with its partition and its place there; the rows per partition then give each
partition its first number.  The only thing summed up in one place is one count
per partition.  The written table also fixes the numbers: an executor lost later
re-reads files instead of sorting again with other range bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.operators.schema import fresh, quoted, require_columns, require_distinct
from gradewell.session import materialize, scratch_path

# ``monotonically_increasing_id`` holds the partition above this bit.
_PLACE_BITS = 33

# Up to here the first numbers of partitions or files (some 100 bytes each) are
# broadcast; beyond, Spark chooses the join.
BROADCAST_PARTS = 500_000

# Up to here the n-th key is found by a top-n over keys alone; beyond, by counts of
# ranges of keys.  Both order ties by reading order and give the same rows.
TOP_N_LIMIT = 10_000


def with_row_index(
    df: DataFrame,
    order_by: list[str] | None = None,
    name: str = "row_index",
    path: str | None = None,
    stored_input: bool = False,
) -> DataFrame:
    """``df`` with a dense index from 0 in the order of ``order_by``.

    Without ``order_by`` rows keep the order they are read in and nothing is
    shuffled.  With it, rows that tie keep that order, which also spreads a key
    shared by very many rows over several partitions.

    The numbered table goes to ``path``, by default a new one in the scratch
    folder.  Before sorting, ``df`` is stored once with its reading order: a
    task run again must find the same order, and looking for the ranges must
    not run what made ``df`` (a model, say) a second time.  ``stored_input``
    spares this copy where ``df`` is read straight from stored files.
    """
    require_columns(df, *(order_by or []))
    require_distinct([*df.columns, name])
    spark = df.sparkSession
    path = path or scratch_path(spark, "rows")
    if order_by:
        keys = [quoted(k) for k in order_by]
        tie = fresh(df, "_read_order")
        read = df.withColumn(tie, F.monotonically_increasing_id())
        if not stored_input:
            read = materialize(read, f"{path}-read")
        df = (
            read.repartitionByRange(*keys, tie)
            .sortWithinPartitions(*keys, tie)
            .drop(tie)
        )
    at = fresh(df, "_place")
    df.withColumn(at, F.monotonically_increasing_id()).write.parquet(path)

    rows = spark.read.parquet(path)
    place = F.col(at).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return _add_index(rows, F.shiftrightunsigned(at, _PLACE_BITS), place, name, f"{path}-starts").drop(at)


def read_numbered(spark: SparkSession, path: str, name: str = "row_index", total: int | None = None) -> DataFrame:
    """Parquet files with a dense index over all rows, in the order of file names.

    Parquet knows each row's place in its file, so nothing is sorted, shuffled
    or copied: only the rows per file are counted, for which no column is read.
    With ``total`` only the files that hold the first rows are read.
    """
    rows = spark.read.parquet(path)
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return _add_index(rows, file, place, name, scratch_path(spark, "starts"), total)


def _add_index(
    rows: DataFrame, part: Column, place: Column, name: str, path: str, total: int | None = None,
) -> DataFrame:
    """The dense index, from each row's part of the table and its place there.

    There is one first number per written partition or listed file.  These are
    stored, so that using the numbers again does not count again, and broadcast
    unless there are too many.
    """
    key, at, start = (fresh(rows, c) for c in ("_part", "_at", "_start"))
    counts = rows.groupBy(part.alias(key)).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    starts, seen = counts.select(key, F.coalesce(before, F.lit(0)).alias(start)), Observation()
    starts = materialize(starts.observe(seen, F.count(F.lit(1)).alias("parts")), path)
    if total:
        last = starts.where(F.col(start) < total).agg(F.max(key)).first()[0]
        rows = rows.where(part <= last)
    if seen.get["parts"] <= BROADCAST_PARTS:
        starts = F.broadcast(starts)
    numbered = rows.select("*", part.alias(key), place.alias(at)).join(starts, key)
    numbered = numbered.withColumn(name, F.col(start) + F.col(at)).drop(key, at, start)
    return numbered.where(quoted(name) < total) if total else numbered


def with_ids(
    df: DataFrame,
    prefix: str = "q",
    order_by: list[str] | None = None,
    name: str = "id",
    stored_input: bool = False,
) -> DataFrame:
    """``df`` with ids ``q0, q1, …``; an input that has ``name`` is refused."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {name!r} exists")
    index = fresh(df, "_index")
    indexed = with_row_index(df, order_by, index, stored_input=stored_input)
    return indexed.withColumn(name, F.concat(F.lit(prefix), index)).drop(index)


def first_rows(df: DataFrame, n: int | None, order_by: list[str], stored_input: bool = False) -> DataFrame:
    """The first ``n`` rows by ``order_by``; all of them for none or zero.

    Rows that tie keep their reading order.  The keys of the n-th row are found
    first, from keys alone; the rows are then filtered by them where they are
    read, without a join, a sort or a shuffle.  For ``stored_input`` see
    ``with_row_index``.
    """
    require_columns(df, *order_by)
    if not n:
        return df
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if any(not isinstance(kinds.get(k), _PLAIN) for k in order_by):
        index = fresh(df, "_index")
        return with_row_index(df, order_by, index, stored_input=stored_input).where(F.col(index) < n).drop(index)
    read = fresh(df, "_read_order")
    rows = df.withColumn(read, F.monotonically_increasing_id())
    if not stored_input:
        rows = materialize(rows, label="rows")
    # Times are compared as numbers: these pass through the driver unchanged.
    keys = [F.unix_micros(quoted(k)) if isinstance(kinds[k], T.TimestampType) else quoted(k) for k in order_by]
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(read).alias("read"))
    last = _nth(rows.select(keys.alias("key")), n)
    if last is None:
        return rows.drop(read)
    values = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, rows.select(keys.alias("key")).schema["key"].dataType.fields)]
    return rows.where(keys <= F.struct(*values)).drop(read)


#: Key types whose values pass through the driver unchanged.
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType)


def _nth(rows: DataFrame, n: int) -> Row | None:
    """The ``n``-th smallest ``key``; none if there are no more rows than ``n``.

    Up to TOP_N_LIMIT each task keeps its first keys.  Beyond, keys are dealt out
    by range and counted, and only the range that holds the n-th one is sorted.
    """
    if n <= TOP_N_LIMIT:
        found = rows.orderBy("key").limit(n).collect()
        return found[-1]["key"] if len(found) == n else None
    dealt = materialize(rows.repartitionByRange("key").withColumn("part", F.spark_partition_id()), label="ranges")
    before = 0
    # One row per partition of a shuffle.
    for r in sorted(dealt.groupBy("part").count().collect()):
        if before + r["count"] >= n:
            return dealt.where(F.col("part") == r["part"]).orderBy("key").offset(n - before - 1).limit(1).first()["key"]
        before += r["count"]
    return None


def batch_columns(index: Column, batch_size: int) -> dict[str, Column]:
    """Batch number and position in the batch from a dense index."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    return {
        "batch_no": F.call_function("div", index, F.lit(batch_size)).cast("long"),
        "pos": (index % F.lit(batch_size)).cast("long"),
    }


def custom_id(batch_no: Column | str = "batch_no", pos: Column | str = "pos") -> Column:
    """Request id that no other batch uses."""
    return F.concat(F.lit("b"), batch_no, F.lit("-"), pos)


def assign_batches(
    df: DataFrame,
    batch_size: int,
    order_by: list[str] | None = None,
    total: int | None = None,
    stored_input: bool = False,
    index_col: str | None = None,
) -> DataFrame:
    """``df`` cut into runs of ``batch_size`` rows; only the last may be short.

    Adds ``batch_no``, ``pos`` and ``custom_id``.  ``total`` keeps the first
    rows only, and needs ``order_by`` or ``index_col`` to say which these are;
    few rows are taken before anything else is done.  ``index_col`` names a
    dense index that is there already, as from ``read_numbered``; it is dropped.
    """
    index = fresh(df, "_index")
    require_distinct([*[c for c in df.columns if c != index_col], "batch_no", "pos", "custom_id"])
    if index_col:
        require_columns(df, index_col)
        rows = df.withColumnRenamed(index_col, index)
    elif total and not order_by:
        raise ValueError("total needs order_by or index_col: rows have no order of their own")
    elif total and total <= TOP_N_LIMIT:
        rows = with_row_index(first_rows(df, total, order_by, stored_input), order_by, index)
    else:
        rows = with_row_index(df, order_by, index, stored_input=stored_input)
    if total:
        rows = rows.where(F.col(index) < total)
    rows = rows.withColumns(batch_columns(F.col(index), batch_size)).drop(index)
    return rows.withColumn("custom_id", custom_id())
