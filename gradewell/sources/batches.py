"""Request files going out and result files coming back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.fixed import REQUEST_MAX_TOKENS, REQUEST_TEMPERATURE
from gradewell.functions.chat import chat
from gradewell.operators.schema import require_columns, require_distinct

RESULT_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StructType([
            T.StructField("content", T.ArrayType(T.StructType([
                T.StructField("type", T.StringType()),
                T.StructField("text", T.StringType()),
            ]))),
        ])),
    ])),
])


def request_records(
    requests: DataFrame,
    model: str,
    max_tokens: int = REQUEST_MAX_TOKENS,
    temperature: float = REQUEST_TEMPERATURE,
    prompt: str = "PROMPT",
) -> DataFrame:
    """One record per prompt: its id, the call's parameters and its batch."""
    require_columns(requests, "custom_id", "batch_no", prompt)
    params = F.struct(
        F.lit(model).alias("model"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.lit(temperature).cast("double").alias("temperature"),
        chat(F.col(prompt)).alias("messages"),
    )
    return requests.select("custom_id", params.alias("params"), "batch_no")


def write_requests(records: DataFrame, path: str, batches_per_folder: int = 1000) -> None:
    """JSON lines with ``custom_id`` and ``params`` only, ready to be sent.

    Rows are clustered by batch first, so a batch lies in one file, in order,
    and a task writes to a few neighbouring folders of ``batches_per_folder``
    consecutive batches.  A folder per batch (1) makes a file one call.
    """
    require_columns(records, "custom_id", "params", "batch_no")
    folder = F.call_function("div", F.col("batch_no"), F.lit(batches_per_folder)).alias("folder")
    clustered = records.repartitionByRange("batch_no").sortWithinPartitions("batch_no", "custom_id")
    clustered.select("custom_id", "params", folder).write.partitionBy("folder").json(path)


def store_requests(requests: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Requests as a table bucketed by custom id, one sorted file per bucket.

    Results come in over and over: matching them to this table shuffles the
    results only, never the requests again.  This takes at least as many
    buckets as ``spark.sql.shuffle.partitions``.
    """
    require_columns(requests, "custom_id")
    writer = requests.repartition(buckets, "custom_id").write.bucketBy(buckets, "custom_id").sortBy("custom_id")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return requests.sparkSession.table(name)


#: Folder column of requests stored by range, with the number of batches in a range.
RANGE = re.compile(r"batch_range_(\d+)")


def store_request_ranges(requests: DataFrame, path: str, batches_per_range: int = 1000) -> DataFrame:
    """Requests in one folder for each ``batches_per_range`` consecutive batches.

    The id of a result says its batch, so matching a few results reads their
    folders only.  The width of a range is part of the folder column's name.
    """
    require_columns(requests, "custom_id", "batch_no")
    if batches_per_range < 1:
        raise ValueError("batches_per_range must be at least 1")
    name = f"batch_range_{batches_per_range}"
    require_distinct([*requests.columns, name])
    ranged = requests.withColumn(name, F.call_function("div", F.col("batch_no"), F.lit(batches_per_range)))
    ranged.repartitionByRange("batch_no").sortWithinPartitions("batch_no", "custom_id").write.partitionBy(name).parquet(path)
    return requests.sparkSession.read.parquet(path)


def range_of(requests: DataFrame) -> tuple[str, int]:
    """Folder column of a table stored by range, and the number of batches in a range."""
    found = [(c, int(m[1])) for c in requests.columns if (m := RANGE.fullmatch(c))]
    if len(found) != 1:
        raise ValueError("requests are not stored by range of batches")
    return found[0]


def model_text(result: Column | str = "result") -> Column:
    """Text of the first content block; null for a failed or empty result."""
    content = F.col(f"{result}.message.content") if isinstance(result, str) else result["message"]["content"]
    return F.get(content, F.lit(0))["text"]


def flat_results(raw: DataFrame) -> DataFrame:
    """``custom_id, MODEL_OUTPUT`` of the results that have text."""
    return raw.select("custom_id", model_text().alias("MODEL_OUTPUT")).where("MODEL_OUTPUT IS NOT NULL")


def result_states(raw: DataFrame) -> DataFrame:
    """``custom_id, batch_no, status`` of every result, failed ones included."""
    return raw.select("custom_id", batch_of("custom_id").alias("batch_no"), F.col("result.type").alias("status"))


def request_states(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """``custom_id, batch_no, status`` of every request: ``processing`` while it
    has no result.  Of several results a succeeded one counts."""
    # Of the state names, "succeeded" is the last in the alphabet.
    found = raw.groupBy("custom_id").agg(F.max("result.type").alias("status"))
    states = requests.select("custom_id", "batch_no").join(found, "custom_id", "left")
    return states.withColumn("status", F.coalesce("status", F.lit("processing")))


def batch_of(custom_id: Column | str) -> Column:
    """Batch number inside a request id; null for a foreign id."""
    return F.regexp_extract(custom_id, r"^b(\d+)-\d+$", 1).try_cast("long")


def count_unreadable(spark: SparkSession, path: str) -> int:
    """Lines under ``path`` that are no result: not JSON, or without a ``custom_id``.  ``read_results`` leaves them out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", RESULT_SCHEMA)
    return lines.where(F.coalesce(parsed["custom_id"].isNull(), F.lit(True))).count()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Flat results of all files under ``path``."""
    return flat_results(spark.read.schema(RESULT_SCHEMA).json(path))
