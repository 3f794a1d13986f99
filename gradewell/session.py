"""Session settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Only for local runs: on a cluster these come from its own configuration.
LOCAL_SETTINGS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
    # Keeps batches of long texts small on their way to a model.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}

#: Seconds between two looks, in a ``temporary`` block, for shuffles that no plan needs any more.
RELEASE_EVERY = 3.0

_local_scratch: str | None = None
_released = 0.0


def local_session(cores: int | str = 8, name: str = "gradewell", **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**LOCAL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one: on a cluster a
    machine-local folder is lost with its machine, so there it is an error.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="gradewell-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, never used before.

    All of an application's paths lie in one folder named by its id, which may
    go when the application has ended.  Give tables that later applications
    read a path of their own instead.
    """
    return f"{scratch_root(spark)}/gradewell-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete all tables this application has written to the shared folder; none may be in use any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/gradewell-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, path: str | None = None, label: str = "rows") -> DataFrame:
    """Write ``df`` and read it back: what it took to make is not done again, also
    not when an executor is lost.  The path is new unless one is given."""
    own = path is None
    if _scopes.open() and time.monotonic() - _released > RELEASE_EVERY:
        release(df.sparkSession)
    path = path or scratch_path(df.sparkSession, label)
    # Scratch tables are read once or twice: a smaller copy is worth some more work.
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if own:
        out.scratch = path
        if _scopes.open():
            _scopes.open()[-1].append(out)
    return out


def materialize_by(df: DataFrame, column: str, label: str = "rows") -> DataFrame:
    """``materialize`` for rows dealt out by ``column`` to the session's shuffle partitions: in as many buckets, so
    that joins on it do not shuffle them again.  The table has a name until ``discard``."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    out.scratch, out.table_name = path, name
    if _scopes.open():
        _scopes.open()[-1].append(out)
    return out


class _Scopes(dict):
    """Tables of the ``temporary`` blocks that are open in each thread, the innermost last.  A pickled one is empty."""

    def open(self) -> tuple[list[DataFrame], ...]:
        return self.get(threading.get_ident(), ())

    def __reduce__(self):
        return _Scopes, ()


_scopes = _Scopes()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stored tables are deleted at its end, all but those passed to the function it gives.

    What leaves the block must not be computed from a deleted table any more:
    store it in the block and keep it.  Shuffle files of plans that nothing refers
    to any more go as well, as soon as Spark's cleaner gets to them.
    """
    tables: list[DataFrame] = []
    outer = _scopes.open()
    _scopes[threading.get_ident()] = (*outer, tables)

    def keep(table: DataFrame) -> DataFrame:
        if any(t is table for t in tables):
            tables[:] = [t for t in tables if t is not table]
            if outer:
                outer[-1].append(table)
        return table

    if not outer:
        release(spark)
    try:
        yield keep
    finally:
        _scopes[threading.get_ident()] = outer
        discard(*tables)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of plans that are not referred to any more."""
    global _released
    _released = time.monotonic()
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` put in the shared folder, once all that was made of them is written.

    A table with a path of its own, or any other DataFrame, is left alone.
    """
    for table in tables:
        path = getattr(table, "scratch", None) if "scratch" in vars(table) else None
        if "table_name" in vars(table):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.table_name}")
        if path:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
