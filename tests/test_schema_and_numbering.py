import pytest
from pyspark.sql import functions as F

from conftest import planned, rows
from gradewell import session
from gradewell.operators import numbering as nb
from gradewell.operators import schema as sc


def test_required_columns(spark):
    df = spark.range(1).withColumn("a.b", F.lit(1))
    sc.require_columns(df, "id", "a.b")
    with pytest.raises(ValueError, match="answer"):
        sc.require_columns(df, "id", "answer")


def test_upper_fields(spark):
    df = spark.createDataFrame([("7", 1.0, None)], "id string, score double, note string")
    assert rows(sc.upper_fields(df, keep="id")) == [("7", "1.0", "None")]
    assert sc.upper_fields(df, keep="id").columns == ["id", "SCORE", "NOTE"]
    mapped = sc.upper_fields(df, {"question": "note", "answer": "id"})
    assert (mapped.columns, rows(mapped)) == (["QUESTION", "ANSWER"], [("None", "7")])


def test_clashing_names(spark):
    with pytest.raises(ValueError, match="clashes"):
        sc.require_distinct(["id", "ID"])
    with pytest.raises(ValueError, match="clashes"):
        sc.require_distinct(["id", "analysis"], ["ANALYSIS"])


def test_defaults(spark):
    df = spark.createDataFrame([(None, None), ("x", True)], "t string, b boolean")
    assert rows(sc.with_defaults(df, {"t": "", "b": False})) == [("", False), ("x", True)]


def test_batches(spark):
    df = spark.range(10).withColumn("key", F.lit(100) - F.col("id"))
    batches = nb.assign_batches(df, 4, ["key"])
    assert rows(batches.groupBy("batch_no").count()) == [(0, 4), (1, 4), (2, 2)]
    assert batches.select("custom_id").distinct().count() == 10
    assert rows(batches.where("custom_id = 'b1-0'").select("id", "pos")) == [(5, 0)]
    with pytest.raises(ValueError):
        nb.assign_batches(df, 0)


def test_batch_total(spark):
    batches = nb.assign_batches(spark.range(10), 4, ["id"], total=6)
    assert rows(batches.select("id", "batch_no")) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    assert nb.assign_batches(spark.range(3), 4, ["id"], total=99).count() == 3
    with pytest.raises(ValueError):
        nb.assign_batches(spark.range(10), 4, total=6)
    assert rows(nb.assign_batches(spark.range(10), 4, ["id"], total=6).select("batch_no", "pos")) == rows(
        batches.select("batch_no", "pos"))


def test_few_rows_are_taken_first(spark, monkeypatch):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("k"))
    few = rows(nb.assign_batches(df.repartition(8), 4, ["k"], total=50))
    monkeypatch.setattr(nb, "TOP_N_LIMIT", 10)
    assert few == rows(nb.assign_batches(df.repartition(8), 4, ["k"], total=50))
    assert min(r[0] for r in few) == 1 and max(r[0] for r in few) == 50


def test_index_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("k"))
    one, many = (nb.with_row_index(df.repartition(n), ["k"]) for n in (1, 8))
    assert rows(one) == rows(many)
    assert [r[0] for r in one.orderBy("k").select("row_index").collect()] == list(range(500))


def test_index_keeps_reading_order(spark):
    df = spark.range(100, numPartitions=7)
    assert all(r.id == r.row_index for r in nb.with_row_index(df).collect())
    assert all(r.id == r.row_index for r in nb.with_row_index(df.withColumn("same", F.lit(1)), ["same"]).collect())


def test_hot_key_is_spread(spark, settings):
    """A third of the rows share a key, another third are copies of one row."""
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.lit(-2)).otherwise(F.col("id")).alias("k"))
    path = session.scratch_path(spark, "hot")
    indexed = nb.with_row_index(df, ["k"], path=path)
    assert indexed.agg(F.count_distinct("row_index"), F.min("row_index"), F.max("row_index")).first()[:] == (30_000, 0, 29_999)
    sizes = [r[0] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().select("count").collect()]
    assert max(sizes) < 30_000 / 4


def test_numbers_are_fixed_once_written(spark):
    """Later use reads files: nothing is sorted or shuffled again."""
    indexed = nb.with_row_index(spark.range(100), ["id"])
    assert "Exchange rangepartitioning" not in planned(indexed)
    assert "Exchange hashpartitioning" not in planned(indexed)
    assert "Window" not in planned(indexed)


def test_numbered_scan(spark, settings):
    """Whole files are numbered in order of their names, however the scan is split."""
    path = session.scratch_path(spark, "scan")
    spark.range(0, 5000, 1, 5).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).write.option(
        "parquet.block.size", 20_000).parquet(path)
    settings(spark__sql__files__maxPartitionBytes="20000")
    numbered = nb.read_numbered(spark, path)
    assert numbered.columns == ["id", "t", "row_index"]
    assert all(r.id == r.row_index for r in numbered.collect())
    assert "Exchange hashpartitioning" not in planned(numbered) and "rangepartitioning" not in planned(numbered)
    first = nb.read_numbered(spark, path, total=1500)
    assert rows(first.select("row_index")) == rows(spark.range(1500)) and first.where("id <> row_index").count() == 0
    assert first.select("id").rdd.getNumPartitions() < numbered.select("id").rdd.getNumPartitions()
    batches = nb.assign_batches(numbered, 7, index_col="row_index", total=20)
    assert rows(batches.groupBy("batch_no").count()) == [(0, 7), (1, 7), (2, 6)]
    assert "t" in batches.columns and "row_index" not in batches.columns
    assert "t:string" not in planned(batches.select("custom_id")).split("ReadSchema")[1]


def test_many_parts_are_not_broadcast_by_hint(spark, settings, monkeypatch):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    df = spark.range(50, numPartitions=5)
    small = nb.with_row_index(df)
    monkeypatch.setattr(nb, "BROADCAST_PARTS", 4)
    large = nb.with_row_index(df)
    assert "BroadcastHashJoin" in planned(small) and "BroadcastHashJoin" not in planned(large)
    assert rows(small) == rows(large)


def test_upstream_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(x):
        seen.add(1)
        return x

    nb.with_row_index(spark.range(200).select(count.asNondeterministic()("id").alias("k")), ["k"]).count()
    assert seen.value == 200


def test_ids(spark):
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    assert rows(nb.with_ids(df, "q", ["k"])) == [("a", "q0"), ("b", "q1")]
    with pytest.raises(ValueError, match="exists"):
        nb.with_ids(df.withColumn("ID", F.lit(1)))


def test_first_rows(spark, monkeypatch):
    df = spark.range(50).select((F.lit(50) - F.col("id")).alias("k"))
    assert nb.first_rows(df, None, ["k"]).count() == nb.first_rows(df, 0, ["k"]).count() == 50
    few = nb.first_rows(df, 5, ["k"])
    assert "SinglePartition" not in planned(few)
    monkeypatch.setattr(nb, "TOP_N_LIMIT", 3)
    many = nb.first_rows(df, 5, ["k"])
    assert rows(few) == rows(many) == [(i,) for i in range(1, 6)]


def test_scratch_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://somewhere"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Cluster)
    Cluster.sparkContext.master = "local[2]"
    assert session.scratch_root(Cluster) == session.scratch_root(Cluster)
    Cluster.conf.get = staticmethod(lambda key, default: "hdfs://shared/")
    assert session.scratch_root(Cluster) == "hdfs://shared"


def test_ties_are_the_same_rows_either_way(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 6).select((F.col("id") % 3).alias("k"), "id")
    few = sorted(nb.first_rows(df, 100, ["k"], stored_input=True).collect())
    monkeypatch.setattr(nb, "TOP_N_LIMIT", 10)
    assert few == sorted(nb.first_rows(df, 100, ["k"], stored_input=True).collect()) == [(0, i) for i in range(0, 300, 3)]


def test_callers_columns_stay(spark):
    names = ["_index", "_place", "_start", "_part", "_at", "_read_order", "_hash", "_out", "_best", "_seq"]
    df = spark.range(6).select("id", *[F.col("id").alias(n) for n in names])
    for out in (nb.with_ids(df, "q", ["id"], "name"), nb.assign_batches(df, 4, ["id"]), nb.first_rows(df, 6, ["id"]),
                nb.with_row_index(df, ["id"])):
        assert out.columns[: len(df.columns)] == df.columns
        assert out.where(" or ".join(f"{n} <> id" for n in names)).count() == 0 and out.count() == 6
    for taken in ("pos", "custom_id", "batch_no"):
        with pytest.raises(ValueError, match="clashes"):
            nb.assign_batches(df.withColumn(taken, F.lit(1)), 4, ["id"])
