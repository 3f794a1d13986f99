"""Text functions: hand-written edges, then random texts against plain Python."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import planned
from gradewell.fixed import WHITESPACE
from gradewell.functions import text as tx


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def check(spark, fn, cases):
    assert apply(spark, fn, [c[0] for c in cases]) == [c[1] for c in cases]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_boxed_answer(spark):
    check(spark, tx.boxed_answer, [
        (r"a \boxed{1} b \boxed{ 42 }", "42"),
        ("none", None),
        (None, None),
        (r"\boxed{\frac{1}{2}}", None),
        (r"\boxed{1} \boxed{\frac{1}{2}}", "1"),
        (r"\boxed{}", None),
        (r"\boxed{ }", ""),
        ("\\boxed{\xa07\t}", "7"),
        ("\\boxed{two\nlines}", "two\nlines"),
        (r"\boxed{never closed", None),
    ])


def test_tagged_section(spark):
    check(spark, lambda c: tx.tagged_section(c, "analysis"), [
        ("<Analysis> a </ANALYSIS>", "a"),
        ("<analysis>1</analysis><analysis>2</analysis>", "1"),
        ("<analysis>a < b</analysis>", "a < b"),
        ("<analysis>a <analysis> b</analysis>", "a <analysis> b"),
        ("<analysis>\xa0\n two\nlines \u2003</analysis>", "two\nlines"),
        ("<analysis></analysis>", ""),
        ("<analysis> open", ""),
        ("</analysis><analysis>after</analysis>", "after"),
        ("no tag", ""),
        (None, None),
    ])


def test_tag_with_pattern_characters(spark):
    check(spark, lambda c: tx.tagged_section(c, "a.b"), [("<a.b>x</a.b>", "x"), ("<aXb>x</aXb>", "")])


def test_tag_letters_fold_like_python(spark):
    texts = ["<analy\u017fi\u017f>x</ANALYSIS>", "<analys\u0131s>x</analysis>", "<analys\u0130s>x</analysis>"]
    pattern = re.compile("<analysis>(.*?)</analysis>", re.I)
    want = [m.group(1) if (m := pattern.search(t)) else "" for t in texts]
    assert apply(spark, lambda c: tx.tagged_section(c, "analysis"), texts) == want


def test_clean_text(spark):
    check(spark, tx.clean_text, [
        ("a \n\n \n  b\t", "a\nb"),
        ("  \n \n", ""),
        ("one line", "one line"),
        ("a\r\n\r\nb", "a\nb"),
        ("\xa0a\u3000\n\x1c\nb", "a\nb"),
        ("", ""),
        (None, ""),
    ])


def test_code_block(spark):
    check(spark, tx.code_block, [
        ("x```python\n1\n```\n```python\n2\n```", "1"),
        ("```python\n```", None),
        ("```python\n\n```", ""),
        ("```python\na\n\n```", "a\n"),
        ("```python\nopen", None),
        ("```\n1\n```", None),
        (None, None),
    ])


def test_append_tool_output(spark):
    assert apply(spark, lambda c: tx.append_tool_output(c, F.lit("7")), ["t"]) == ["t\n7\n```"]


def test_render(spark):
    values = spark.createDataFrame([("A", "x {{c}} {{a}}", r"$1 \ {{b}}", None)], "a string, b string, c string, n string")

    def fill(template, **slots):
        return values.select(tx.render(template, {k: F.col(v) for k, v in slots.items()}).alias("t")).first().t

    assert fill("{{a}}-{{a}} {{z}}", a="a") == "A-A {{z}}"
    # A later slot inside a value is filled, an earlier one and its own are not.
    assert fill("[{{b}}] [{{c}}]", a="a", b="b", c="c") == r"[x $1 \ {{b}} {{a}}] [$1 \ {{b}}]"
    assert fill("[{{c}}] [{{b}}]", c="c", b="b") == r"[$1 \ x {{c}} {{a}}] [x {{c}} {{a}}]"
    assert fill("{{a}}", a="n") is None
    assert fill("no slots") == "no slots"
    assert fill("no slots", a="a") == "no slots"


def in_turn(template, values):
    for slot, value in values.items():
        template = template.replace("{{" + slot + "}}", value)
    return template


def test_render_like_replacing_in_turn(spark):
    pick = random.Random(5)
    parts = ["{{a}}", "{{b}}", "{{c}}", "{{", "}}", "{", "}", "a", "b", " ", "\n", "<", "x"]

    def text(most):
        return "".join(pick.choice(parts) for _ in range(pick.randint(0, most)))

    templates = [text(9) for _ in range(25)] + ["<{{a}}>\n<{{b}}> {{c}}\n", "{{a}}\n{{b}}", "{{a}}{{b}}", "{{a}}}}", "{{{{a}}"]
    data = [(i, text(6), text(6), text(6)) for i in range(60)]
    df = spark.createDataFrame(data, "i int, a string, b string, c string")
    out = df.select("*", *[
        tx.render(t, {s: F.col(s) for s in "abc"}).alias(f"t{n}") for n, t in enumerate(templates)]).collect()
    for row in out:
        for n, template in enumerate(templates):
            assert row[f"t{n}"] == in_turn(template, {s: row[s] for s in "abc"}), (template, row)


def test_stringify(spark):
    schema = "b boolean, i int, s string, a array<array<string>>, d double"
    df = spark.createDataFrame([(True, 7, "007", [["x", "y"]], 0.5), (None,) * 5], schema)
    one, none = df.select(*[tx.stringify(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).collect()
    assert tuple(one) == ("True", "7", "007", '[["x","y"]]', "0.5")
    assert tuple(none) == ("None",) * 5
    kept = df.select(tx.stringify(F.col("s"), null_text=None).alias("s")).collect()
    assert [r.s for r in kept] == ["007", None]


def test_times_print_as_in_python(spark):
    times = [datetime.datetime(2024, 1, 2, 3, 4, 5, us) for us in (0, 170000, 179575)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    got = df.select("i", tx.stringify(F.col("t"), T.TimestampNTZType()).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [str(t) for t in times]


def test_doubles_print_as_in_python(spark):
    pick = random.Random(3)
    numbers = [0.0, -0.0, 1.0, 1e15, 1e16, 1e20, -1e22, 0.001, 1e-4, 1e-5, 1.5e-7, 12345678.9, 1234567.0, 6.06e18,
               float("inf"), float("-inf"), float("nan")]
    numbers += [round(pick.uniform(-1e9, 1e9), pick.randint(0, 6)) for _ in range(500)]
    numbers += [round(pick.uniform(-1, 1), 5) * 10.0 ** pick.randint(-12, 3) for _ in range(200)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double")
    got = [r.s for r in df.select("i", tx.stringify(F.col("n"), T.DoubleType()).alias("s")).orderBy("i").collect()]
    # Products of powers of ten may carry a digit too many in older JVMs: compare by value there.
    for n, s in zip(numbers, got):
        assert s == str(n) or (float(s) == n and "e" in s and "e" in str(n)), (n, s)


# --- random texts ------------------------------------------------------------

PIECES = [
    r"\boxed{", "}", "{", "<analysis>", "</analysis>", "<ANALYSIS>", "</Analysis>", "<", ">", "```python\n", "\n```",
    "```", "\n", "\n\n", " ", "\t", "\xa0", "\u2003", "\x1d", "\x85", "a", "42", "ß", "é", "\\", "correct", "In", "wrong",
    "not ", "WRONG", "Correct", ".",
]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(11)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 25))) for _ in range(3000)]


def test_boxed_like_python(spark, texts):
    want = []
    for t in texts:
        found = re.findall(r"\\boxed\{([^{}]+)\}", t)
        want.append(found[-1].strip() if found else None)
    assert apply(spark, tx.boxed_answer, texts) == want
    assert len(set(want)) > 20


def test_tags_like_python(spark, texts):
    pattern = re.compile(r"<analysis>\s*(.*?)\s*</analysis>", re.DOTALL | re.IGNORECASE)
    want = [m.group(1).strip() if (m := pattern.search(t)) else "" for t in texts]
    assert apply(spark, lambda c: tx.tagged_section(c, "analysis"), texts) == want
    assert len(set(want)) > 100


def test_cleaning_like_python(spark, texts):
    want = ["\n".join(line.strip() for line in re.sub(r"\n\s*\n", "\n", t).split("\n")).strip() for t in texts]
    assert apply(spark, tx.clean_text, texts) == want


def test_code_like_python(spark, texts):
    pattern = re.compile(r"```python\n(.*?)\n```", re.DOTALL)
    want = [m.group(1) if (m := pattern.search(t)) else None for t in texts]
    assert apply(spark, tx.code_block, texts) == want
    assert len(set(want)) > 20


def test_strip_like_python(spark, texts):
    assert apply(spark, tx.strip, texts) == [t.strip() for t in texts]


def test_hostile_texts_stay_cheap(spark):
    """Whole texts of a megabyte that defeat backtracking patterns."""
    hostile = ["<analysis>" * 100_000, "```python\n" * 100_000, r"\boxed{" * 100_000, " " * 1_000_000 + "x",
               "\n" + " " * 1_000_000 + "x", "<analysis>" + "<" * 1_000_000]
    df = spark.createDataFrame([(t,) for t in hostile], "v string")
    start = time.time()
    df.select(
        F.length(tx.tagged_section("v", "analysis")), tx.code_block("v"), tx.boxed_answer("v"),
        F.length(tx.clean_text("v")), F.length(tx.strip("v")),
    ).collect()
    assert time.time() - start < 20


def test_no_python_in_text_functions(spark):
    df = spark.createDataFrame([("x",)], "v string").select(
        tx.tagged_section("v", "a"), tx.clean_text("v"), tx.boxed_answer("v"), tx.code_block("v"),
        tx.render("{{v}}", {"v": tx.stringify("v")}))
    assert "Python" not in planned(df)
