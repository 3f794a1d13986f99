"""Stored and restarted model runs, batches by length, and narrow plans."""

import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import final_plan, planned, rows
from gradewell import session
from gradewell.operators import matching as mt
from gradewell.operators import numbering as nb
from gradewell.operators import selection as se
from gradewell.operators.inference import model_output
from gradewell.plans import execution
from gradewell.plans.execution import best_of_n_responses, execute_stored

# Python workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def path(spark):
    return session.scratch_path(spark, "test")


def test_few_calls_find_a_bad_row(spark, path):
    """Halves: some calls that double with the batch's size once each, not one a row."""
    import glob

    folder = path.removeprefix("file:")

    def make():
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)

        def run(texts):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            if "bad" in texts:
                raise RuntimeError("bad text")
            return [t.upper() for t in texts]

        return run

    texts = [("bad" if i == 77 else f"t{i}",) for i in range(256)]
    out = spark.createDataFrame(texts, "t string").coalesce(1).select("t", model_output(make, F.col("t"), 256).alias("o")).select("t", "o.response", "o.status").collect()
    assert [(r.response, r.status) for r in out] == [("", "error") if t == "bad" else (t.upper(), "success") for t, in texts]
    assert len(glob.glob(f"{folder}/*")) <= 1 + 2 * 8


def test_batches_of_similar_length(spark):
    """Rows come back in order, and rows times the longest text stay within the budget."""
    def make():
        return lambda texts: [f"{len(texts)}x{max(map(len, texts))}:{t}" for t in texts]

    pick = random.Random(3)
    texts = ["x" * pick.choice([1, 2, 3, 50, 400]) + str(i) for i in range(700)] + ["y" * 5000, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    out = df.select("id", "t", model_output(make, F.col("t"), 32, padded=1000)["response"].alias("r")).collect()
    assert [r.r.split(":", 1)[1] for r in out] == texts
    sizes = [tuple(map(int, r.r.split(":", 1)[0].split("x"))) for r in out]
    assert all(n <= 32 and (n * longest <= 1000 or n == 1) for n, longest in sizes)
    # Neighbours as they come would have been padded to 400 characters nearly everywhere.
    assert sum(longest for _, longest in sizes) < 1.2 * sum(map(len, texts))
    drawn = df.select("t", model_output(lambda: lambda ts, ns: [f"{t}/{n}" for t, n in zip(ts, ns)], F.col("t"), 8, samples=2, padded=100)["response"].alias("r"))
    assert all(r.r == [f"{r.t}/0", f"{r.t}/1"] for r in drawn.collect())
    with pytest.raises(ValueError):
        model_output(make, F.col("t"), 8, padded=0)


def test_best_of_n_status(spark):
    df = spark.createDataFrame([("fine",), ("never",), ("once",)], "question string")

    def sampler():
        def draw(chats, numbers):
            if any("never" in c or ("once" in c and n != 1) for c, n in zip(chats, numbers)):
                raise RuntimeError("no sample")
            return [f"s{n}" for n in numbers]

        return draw

    out = best_of_n_responses(df, "question", sampler, lambda: lambda chats: [float(len(c)) for c in chats], 3, batch_size=2, status=True)
    assert rows(out) == [("fine", "s0", "success", None), ("never", "", "error", "no sample"), ("once", "s1", "success", None)]
    # The question goes to the scorer once a row.
    plan = planned(out)
    scorer = plan.split("ArrowEvalPython")[1]
    assert scorer.count("best option") <= 1 and plan.count("ArrowEvalPython") == 2


def test_a_second_run_makes_the_rest_only(spark, path):
    store, seen = f"{path}/store", f"{path.removeprefix('file:')}/seen"

    def model(name, fails=()):
        def make():
            import os
            import uuid

            os.makedirs(seen, exist_ok=True)

            def run(chats):
                asked = [c.split("user\n")[1].split("<|im_end|>")[0] for c in chats]
                if set(asked) & set(fails):
                    raise RuntimeError("failed")
                with open(f"{seen}/{name}-{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(asked))
                return [f"{name} {a}" for a in asked]

            return run

        return make

    def asked_of(name):
        out = []
        for f in os.listdir(seen):
            if f.startswith(f"{name}-"):
                out += open(f"{seen}/{f}").read().split("\n")
        return sorted(out)

    df = spark.createDataFrame([(i, f"q{i % 8}") for i in range(12)], "id int, question string")
    first = execute_stored(df.where("id < 5"), "question", model("one", ["q2"]), store, "m", batch_size=4, rounds=3)
    assert rows(first.select("id", "model_response", "status")) == [
        (i, "" if i == 2 else f"one q{i}", "error" if i == 2 else "success") for i in range(5)]
    second = execute_stored(df, "question", model("two"), store, "m", batch_size=4, rounds=3)
    # Equal questions are asked once, and the one that failed once more.
    assert asked_of("two") == ["q2", "q5", "q6", "q7"]
    want = [(i, f"{'one' if i % 8 in (0, 1, 3, 4) else 'two'} q{i % 8}", "success", None) for i in range(12)]
    assert rows(second.select("id", "model_response", "status", "error")) == sorted(want, key=repr)
    # Another model, or another sample, has answers of its own.
    assert rows(execute_stored(df, "question", model("three"), store, "other", rounds=2).select("model_response"))[0] == ("three q0",)
    assert rows(execute_stored(df, "question", model("four"), store, "m", rounds=2, sample_no=1).select("model_response"))[0] == ("four q0",)
    with pytest.raises(ValueError):
        execute_stored(df, "question", model("five"), store, "m", rounds=0)


def test_a_stopped_run_keeps_its_rounds(spark, path, monkeypatch):
    df = spark.createDataFrame([(f"q{i}",) for i in range(40)], "question string")
    calls, output = [], execution.model_output

    def stop_at_third(*args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return output(*args, **options)

    monkeypatch.setattr(execution, "model_output", stop_at_third)
    with pytest.raises(KeyboardInterrupt):
        execute_stored(df, "question", lambda: lambda ts: ["early"] * len(ts), path, "m", rounds=4)
    monkeypatch.setattr(execution, "model_output", output)
    got = [r.model_response for r in execute_stored(df, "question", lambda: lambda ts: ["late"] * len(ts), path, "m", rounds=4).collect()]
    assert 5 < got.count("early") < 35 and got.count("early") + got.count("late") == 40


# --- narrow plans ------------------------------------------------------------


def test_last_wins_over_stored_rows(spark, path):
    pick = random.Random(1)
    data = [(pick.choice([None, "a", "b", f"k{i % 90}"]), pick.choice([None, float("nan"), float(i), float(i // 3)]), f"text {i}") for i in range(400)]
    spark.createDataFrame(data, "id string, seq double, t string").repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    got = mt.last_wins(df, "id", "seq", stored_input=True)
    def text(found):
        return sorted(map(repr, rows(found)))

    assert text(got.select("id", "seq")) == text(mt.last_wins(df, "id", "seq").select("id", "seq")) and got.columns == df.columns
    assert set(text(got)) <= set(text(df))
    plan = final_plan(got)
    assert "SortAggregate" not in plan and "BroadcastHashJoin" in plan


def test_last_wins_of_very_many_keys(spark, path, monkeypatch):
    spark.range(500).select((F.col("id") % 200).alias("k"), "id", F.col("id").cast("string").alias("t")).write.parquet(path)
    df = spark.read.parquet(path)
    want = rows(mt.last_wins(df, "k", "id"))
    monkeypatch.setattr(mt, "BROADCAST_WINNERS", 10)
    assert rows(mt.last_wins(df, "k", "id", stored_input=True)) == want


def test_groups_are_checked_before_texts_are_collected(spark):
    df = spark.range(30).select(
        F.when(F.col("id") > 2, F.expr("id div 3")).alias("question_id"), (F.col("id") % 3).cast("int").alias("sample_no"),
        F.when(F.col("id") != 4, F.concat(F.lit("t"), "id")).alias("response"))
    got = se.group_candidates(df, 3)
    assert "SortAggregate" not in final_plan(got)
    found = dict(rows(got))
    assert len(found) == 10 and found[1] == ["t3", None, "t5"] and found[9] == ["t27", "t28", "t29"] and found[None] == ["t0", "t1", "t2"]
    twice = df.unionByName(spark.range(1000).select(F.lit(5).cast("long").alias("question_id"), F.lit(0).alias("sample_no"), F.lit("x").alias("response")))
    with pytest.raises(Exception, match="two rows for one sample number"):
        se.group_candidates(twice, 3).collect()


@pytest.mark.parametrize("limit", [10_000, 3])
def test_first_rows_are_filtered_by_the_last_key(spark, path, monkeypatch, limit):
    monkeypatch.setattr(nb, "TOP_N_LIMIT", limit)
    pick = random.Random(2)
    data = [(pick.choice([None, "", "a", "b", "ü"]), pick.choice([None, float("nan"), -1.5, 0.0, 2.0]), pick.choice([None, b"", b"\x00", b"\xff"]), i) for i in range(300)]
    df = spark.createDataFrame(data, "s string, d double, b binary, i long")
    df = df.withColumn("at", F.timestamp_micros(F.col("i") % 7 * 1_700_000_000_123_457)).withColumn("day", F.to_date("at")).withColumn("q", (F.col("i") % 4).cast("decimal(9,2)"))
    df.coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    for keys in (["s", "d"], ["d", "s"], ["b"], ["at", "s"], ["day", "q"], ["q", "d", "b"]):
        for n in (1, 7, 150, 299, 300, 301):
            want = rows(df.orderBy(*keys, "i").limit(n).select("i"))
            got = nb.first_rows(df, n, keys, stored_input=True)
            assert rows(got.select("i")) == want and got.columns == df.columns
    plan = planned(nb.first_rows(df, 20, ["s"], stored_input=True))
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan


def test_first_rows_by_nested_keys(spark):
    df = spark.range(20).select(F.struct((-F.col("id")).alias("x")).alias("k"), "id")
    assert rows(nb.first_rows(df, 3, ["k"]).select("id")) == [(17,), (18,), (19,)]
