"""Results as they arrive: each finished file is matched to its requests once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradewell.operators.matching import match_results
from gradewell.operators.schema import require_distinct
from gradewell.session import materialize, temporary
from gradewell.sources.batches import RESULT_SCHEMA, batch_of, flat_results, range_of

#: Up to here the ranges that results belong to (8 bytes each) are broadcast; beyond, Spark chooses the join.
BROADCAST_RANGES = 500_000


def stream_results(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Flat results as a stream over the JSON files under ``path``."""
    reader = spark.readStream.schema(RESULT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return flat_results(reader.json(path))


def ingest_results(requests: DataFrame, results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Match all results that have arrived, append them to ``path`` and stop.

    The join with the stored requests keeps no state.  A later run goes on
    after the files read so far, so results can be picked up as batches end.
    Each run reads the requests: give it those of the batches still open, by a
    filter on the stored ``batch_no`` that the scan can use.  The written rows
    may hold several results per request; ``last_wins`` over the table settles
    them.
    """
    return (
        match_results(requests, results)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def match_in_ranges(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Stored requests with their results, reading the folders of the results' batches only.

    ``requests``: a table from ``store_request_ranges``; ``results``: flat
    results, read twice, so give stored ones.  The distinct ranges of the results
    are joined first, which prunes the scan of the requests before it starts.
    Results with a foreign id match nothing.  Without the folder column.
    """
    folder, width = range_of(requests)
    require_distinct(requests.columns + [c for c in results.columns if c != "custom_id"])
    located = results.withColumn("batch_no", batch_of("custom_id")).where("batch_no >= 0")
    located = located.withColumn(folder, F.call_function("div", F.col("batch_no"), F.lit(width)))
    ranges = materialize(located.select(folder).distinct(), label="ranges")
    n = ranges.count()
    # The condition holds anyway; it tells the planner that this side chooses.
    ranges = ranges.where(F.col(folder) >= 0)
    own = requests.join(F.broadcast(ranges) if n <= BROADCAST_RANGES else ranges, folder, "left_semi")
    return own.join(located.drop(folder), ["batch_no", "custom_id"]).select(*[c for c in requests.columns if c != folder], *[c for c in results.columns if c != "custom_id"])


def ingest_ranges(requests: DataFrame, results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Match all results that have arrived to requests stored by range, write them under ``path`` and stop.

    Each micro-batch reads the folders of its own batches and writes a folder of
    its own number: run again after a failure, it overwrites what it wrote before,
    so nothing is written twice.  These numbers belong to ``checkpoint``; a path
    that was written under another one is refused.  ``read_ingested`` reads all.
    """
    spark = requests.sparkSession
    range_of(requests)
    if not _exists(spark, checkpoint) and _exists(spark, path):
        raise ValueError(f"{path} was written under another checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        with temporary(spark):
            stored = materialize(batch, label="results")
            match_in_ranges(requests, spark.read.schema(stored.schema).parquet(stored.scratch)).write.mode("overwrite").parquet(f"{path}/ingest={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``ingest_ranges`` has written; several results of a request are all there, as ``last_wins`` settles."""
    return spark.read.parquet(path).drop("ingest")


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
