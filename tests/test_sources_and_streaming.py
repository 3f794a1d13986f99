import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import planned, rows
from gradewell import session
from gradewell.operators import grading, matching, numbering
from gradewell.sources import batches, tables
from gradewell.streaming.results import ingest_ranges, ingest_results, match_in_ranges, read_ingested, stream_results

AWKWARD = [("007", 'a "quoted", text\nover lines ', "x"), ("008", None, " é\t"), ("009", "back\\slash", '""')]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "id string, text string, other string")


@pytest.fixture
def path(spark):
    return session.scratch_path(spark, "test")


def test_csv(spark, awkward, path):
    tables.write_csv(awkward.select("text", "id", "other"), path)
    back = tables.read_csv(spark, path)
    assert back.columns == ["id", "text", "other"] and rows(back) == AWKWARD
    assert rows(tables.read_csv(spark, path, ["id", "text", "other"])) == AWKWARD
    carriage = spark.createDataFrame([("1", "a\r\nb\rc")], "id string, text string")
    tables.write_csv(carriage, path + "-cr")
    assert rows(tables.read_csv(spark, path + "-cr")) == [("1", "a\r\nb\rc")]
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, path, ["id", "other", "text"]).collect()
    assert rows(tables.csv_to_parquet(spark, path, path + "-parquet")) == AWKWARD


def test_json(spark, awkward, path):
    tables.write_json(awkward, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted((tuple(d.values()) for d in lines), key=repr) == AWKWARD
    assert "é" in "".join(r.value for r in spark.read.text(path).collect())
    tables.write_json(awkward, path + "-keyed", keyed_by="id")
    keyed = {}
    for r in spark.read.text(path + "-keyed").collect():
        keyed.update(json.loads(r.value))
    assert keyed["008"] == {"id": "008", "text": None, "other": " é\t"}
    assert rows(tables.read_keyed_json(spark, path + "-keyed", awkward.schema)) == AWKWARD


def test_splits(spark, path):
    df = spark.range(6).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("test"))
    df.write.partitionBy("split").parquet(path)
    train = tables.read_split(spark, path, "train", split_col="split")
    assert (train.columns, rows(train)) == (["id"], [(0,), (1,), (2,), (3,)])
    assert "PartitionFilters: [isnotnull(split" in planned(train)
    df.where("split = 'test'").drop("split").write.json(path + "-folders/test")
    assert rows(tables.read_split(spark, path + "-folders", "test", "json")) == [(4,), (5,)]


# --- request and result files ------------------------------------------------


def requests_of(spark, n, size):
    df = spark.range(n).select("id", F.concat(F.lit("prompt "), "id").alias("PROMPT"))
    return numbering.assign_batches(df, size, ["id"])


def test_request_files(spark, path):
    records = batches.request_records(requests_of(spark, 10, 4), "m", 50, 0.25)
    batches.write_requests(records, path, batches_per_folder=2)
    assert sorted(d for d in os.listdir(path.removeprefix("file:")) if d.startswith("folder")) == ["folder=0", "folder=1"]
    lines = [json.loads(r.value) for r in spark.read.text(path + "/folder=1").collect()]
    assert sorted(d["custom_id"] for d in lines) == ["b2-0", "b2-1"]
    assert next(d for d in lines if d["custom_id"] == "b2-1") == {
        "custom_id": "b2-1", "params": {
            "model": "m", "max_tokens": 50, "temperature": 0.25, "messages": [{"role": "user", "content": "prompt 9"}]}}


def test_unreadable_results_are_counted(spark, path):
    spark.createDataFrame([('{"custom_id": "b0-0"}',), ("{broken",), ('{"id": 1}',), ("",)], "value string").write.text(path)
    assert batches.count_unreadable(spark, path) == 2


def test_stored_requests_are_not_shuffled_again(spark, path, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    stored = batches.store_requests(requests_of(spark, 100, 4), "stored_requests", 8, path)
    results = spark.range(200).select(
        F.concat(F.lit("b"), F.col("id") % 30, F.lit("-0")).alias("custom_id"), F.col("id").alias("n"), F.lit("out").alias("MODEL_OUTPUT"))
    matched = matching.match_results(stored, results, "n")
    plan = planned(matched)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert matched.count() == 25
    spark.sql("DROP TABLE stored_requests")


def result_line(custom_id, state="succeeded", texts=("out",)):
    message = None if state != "succeeded" else {"content": [{"type": "text", "text": t} for t in texts]}
    return json.dumps({"custom_id": custom_id, "result": {"type": state, "message": message}})


LINES = [result_line("b0-0", texts=("first", "second")), result_line("b0-1", "errored"), result_line("b0-2", texts=()),
         result_line("b1-0"), result_line("x"), "not json", json.dumps({"custom_id": "b1-1"})]


def write_lines(spark, path, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(path)


def test_results(spark, path):
    write_lines(spark, path, LINES)
    assert rows(batches.read_results(spark, path)) == [("b0-0", "first"), ("b1-0", "out"), ("x", "out")]
    raw = spark.read.schema(batches.RESULT_SCHEMA).json(path).where("custom_id IS NOT NULL")
    assert rows(batches.result_states(raw).where("status = 'errored' OR custom_id = 'x'")) == [
        ("b0-1", 0, "errored"), ("x", None, "succeeded")]


def test_states_of_requests(spark, path):
    write_lines(spark, path, [*LINES, result_line("b0-1")])
    raw = spark.read.schema(batches.RESULT_SCHEMA).json(path)
    states = batches.request_states(requests_of(spark, 5, 3), raw)
    assert rows(states) == [
        ("b0-0", 0, "succeeded"), ("b0-1", 0, "succeeded"), ("b0-2", 0, "succeeded"),
        ("b1-0", 1, "succeeded"), ("b1-1", 1, "processing")]
    assert rows(grading.batch_status(states).select("batch_no", "ended")) == [(0, True), (1, False)]


def test_streaming_gives_what_one_read_gives(spark, path):
    requests = requests_of(spark, 8, 4)
    files, out, progress = path + "-files", path + "-out", path + "-progress"
    write_lines(spark, files, LINES)

    def ingest():
        ingest_results(requests, stream_results(spark, files, 1), out, progress).awaitTermination()
        return rows(spark.read.parquet(out).select("custom_id", "id", "MODEL_OUTPUT"))

    assert ingest() == [("b0-0", 0, "first"), ("b1-0", 4, "out")]
    # Results that arrive later are added; those read before are not read again.
    write_lines(spark, files, [result_line("b1-3", texts=("late",))])
    got = ingest()
    assert got == [("b0-0", 0, "first"), ("b1-0", 4, "out"), ("b1-3", 7, "late")]
    batch = requests.join(batches.read_results(spark, files), "custom_id")
    assert got == rows(batch.select("custom_id", "id", "MODEL_OUTPUT"))


def spoil(path):
    """Make every file of a folder unreadable."""
    for name in os.listdir(path.removeprefix("file:")):
        if name.endswith(".parquet"):
            with open(f"{path.removeprefix('file:')}/{name}", "wb") as f:
                f.write(b"not parquet")


def test_only_the_folders_of_the_results_are_read(spark, path):
    stored = batches.store_request_ranges(requests_of(spark, 40, 2), path, batches_per_range=5)
    assert batches.range_of(stored) == ("batch_range_5", 5)
    results = spark.createDataFrame([("b6-1", "x"), ("b9-0", "y"), ("b12-7", "no such request"), ("foreign", "z"), (None, "n")], "custom_id string, MODEL_OUTPUT string")
    for folder in (0, 3):
        spoil(f"{path}/batch_range_5={folder}")
    got = match_in_ranges(stored, results)
    assert got.columns == ["id", "PROMPT", "batch_no", "pos", "custom_id", "MODEL_OUTPUT"]
    assert rows(got.select("id", "custom_id", "MODEL_OUTPUT")) == [(13, "b6-1", "x"), (18, "b9-0", "y")]
    with pytest.raises(Exception, match="parquet"):
        stored.collect()


def test_micro_batches_read_their_folders_and_overwrite_themselves(spark, path):
    stored = batches.store_request_ranges(requests_of(spark, 8, 2), path, batches_per_range=1)
    files, out, progress = path + "-files", path + "-out", path + "-progress"
    write_lines(spark, files, [result_line("b0-0"), result_line("b0-1", "errored"), result_line("x"), "not json"])

    def ingest():
        ingest_ranges(stored, stream_results(spark, files, 1), out, progress).awaitTermination()
        return rows(read_ingested(spark, out).select("custom_id", "id", "MODEL_OUTPUT"))

    assert ingest() == [("b0-0", 0, "out")]
    # Folders of batches without new results are not read again.
    spoil(f"{path}/batch_range_1=0")
    spoil(f"{path}/batch_range_1=3")
    write_lines(spark, files, [result_line("b2-1", texts=("late",))])
    want = [("b0-0", 0, "out"), ("b2-1", 5, "late")]
    assert ingest() == want
    # A micro-batch whose end was not noted is done again and written once.
    commits = f"{progress.removeprefix('file:')}/commits"
    os.remove(f"{commits}/1")
    if os.path.exists(f"{commits}/.1.crc"):
        os.remove(f"{commits}/.1.crc")
    assert ingest() == want
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest_ranges(stored, stream_results(spark, files, 1), out, progress + "-new")


def test_requests_without_ranges_are_refused(spark, path):
    with pytest.raises(ValueError, match="by range"):
        match_in_ranges(requests_of(spark, 4, 2), spark.createDataFrame([("b0-0", "x")], "custom_id string, MODEL_OUTPUT string"))
    with pytest.raises(ValueError, match="at least 1"):
        batches.store_request_ranges(requests_of(spark, 4, 2), path, 0)
