import math
import random
import re

import duckdb
import pytest
from helpers import LONG, ODD, prose, table, words
from pyspark.sql import functions as F

from gradewell.llm import chat_trees, decontamination, license_scan, quality
from gradewell.llm.queries import QUERIES, SQL
from oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), SQL[name]) == []


NATIVE = ["op1_license_scan", "op2_benchmark_decontamination", "op7_chat_formatting", "op10_quality_rules"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --- decontamination ----------------------------------------------------------


def contained(docs, items):
    def grams(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}
    held = {}
    for i, t in docs:
        if i is not None:
            held.setdefault(i, set()).update(grams(t))
    return {(d, k, len(g & grams(t)), len(grams(t))) for d, g in held.items() for k, t in items
            if grams(t) and len(g & grams(t)) >= 0.8 * len(grams(t)) - 1e-9}


def test_items_are_found_in_long_documents(spark):
    items = [(i, prose(600 + i, 10 + 9 * i)) for i in range(25)] + [(90, None), (91, "four words are few"), (92, prose(605, 55))]
    rows = list(ODD)
    for i in range(25):
        own = items[i][1].split(" ")
        pick = random.Random(i)
        for _ in range(i % 5):
            own[pick.randrange(len(own))] = "changed"
        rows.append((i, f"{LONG[: 3000 * i]} {' '.join(own).upper()}, {prose(700 + i, 50)}"))
    df = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = decontamination.contained_items(table(spark, rows), df).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == contained(rows, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) > 10
    kept = decontamination.drop_contaminated(table(spark, rows), df)
    gone = {r.doc_id for r in got}
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((i or -1) for i, _ in rows if i not in gone)


def test_empty_sides(spark):
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontamination.contained_items(table(spark, []), items).count() == 0
    assert decontamination.contained_items(table(spark, ODD), items.where("false")).count() == 0


# --- quality ------------------------------------------------------------------

def test_common_words_are_found_by_parts(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(120 + i)).title() + " \u0416 \u4e2d #1.") for i in range(25)]
    docs = table(spark, rows).selectExpr("doc_id", "text", "'x' as lang")
    r = quality.common_words(docs).collect()[0]
    assert [w for part in r.ref_parts for w in part] != r.ref_words and sorted(w for part in r.ref_parts for w in part) == r.ref_words
    assert max(map(len, r.ref_parts)) < len(r.ref_words) / 4
    share = dict(zip(r.ref_words, r.ref_shares))

    def divergence(p, q):
        return sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2
    for got in quality.quality(docs).collect():
        own = dict(rows)[got.doc_id].lower().split()
        p, q = [own.count(w) / len(own) for w in share], list(share.values())
        want = math.sqrt(max(0, divergence([*p, 1 - sum(p)], [*q, 1 - sum(q)])))
        assert abs(got.word_distance - want) < 1e-6



def brute_counts(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i: i + 3]), []).append(i)
    repeated = {i + k for places in where.values() if len(places) > 1 for i in places for k in range(3)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), failed)


def test_base_counts(spark):
    rows = ODD + [(1, "a " * 300), (2, prose(3, 120)), (3, prose(3, 60) + "\n" + prose(3, 60)), (4, "x\n\n x\nx\n" * 30),
                  (5, "# | <b> 100% & $5 * " * 20), (6, " ".join(f"w{i % 70} v{i % 35} u{i % 7}" for i in range(400)))]
    got = quality.quality(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(
        (i or -1, *brute_counts(t)) for i, t in rows)
    assert all(not r.kept for r in got if r.base_failed)


def test_longer_texts_are_compared_in_full(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choice("abcde") for _ in range(40 + 9 * i))) for i in range(20)]
    monkeypatch.setattr(quality, "_PLACE", 6)
    got = {r.doc_id: r.n_repeat_words for r in quality.quality(table(spark, rows)).collect()}
    assert got == {i: brute_counts(t)[4] for i, t in rows}


def test_unusual_texts_go(spark):
    rows = [(i, prose(i, 150) + " the of and " * 1) for i in range(60)]
    rows += [(100, " ".join(f"{i}{i * 7}" for i in range(1000, 1300))), (101, " ".join(w + "%%%" for w in prose(5, 200).split())), (102, prose(9, 150), None)]
    kept = {r.doc_id: r.kept for r in quality.quality(table(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] == [100, 101]
    out = quality.drop_low_quality(table(spark, rows))
    assert out.columns == table(spark, rows).columns and out.count() == len(rows) - 2
    assert quality.quality(table(spark, [])).count() == quality.drop_low_quality(table(spark, [])).count() == 0


# --- licences -----------------------------------------------------------------


@pytest.fixture(scope="module")
def licences(spark):
    return license_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_licences(spark, licences):
    """Rows that took no part in training: documents of another table, with notices of all families put in."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 9000").select("doc_id", "text")
    families = [(f, t) for f in license_scan.FAMILIES for t in license_scan.NOTICES[f]]
    notes = F.array(*[F.lit(t) for _, t in families])
    n = F.col("doc_id") % (2 * len(families))
    docs = docs.withColumn("text", F.when(n < len(families), F.concat("text", F.lit("\nNote. "), F.element_at(notes, (n + 1).cast("int")), F.lit(" See there.\nEnd.")))
                           .otherwise(F.col("text"))).withColumn("n", n)
    got = {r.doc_id: r.licence for r in license_scan.scan_licences(docs, licences).collect()}
    rows = docs.where(~F.col("text").rlike("(?i)licen[sc]e.*\n.*licen[sc]e|rights reserved.*\n.*licen|licen.*\n.*rights reserved")).collect()
    right = [got[r.doc_id] == (families[r.n][0] if r.n < len(families) else got[r.doc_id]) for r in rows]
    assert sum(right) / len(right) > 0.97, [(families[r.n], got[r.doc_id]) for r, x in zip(rows, right) if not x][:20]
    clean = [got[r.doc_id] == "none" for r in rows if r.n >= len(families) and not re.search("(?i)licen[sc]e|rights reserved", r.text)]
    assert sum(clean) / len(clean) > 0.995


def test_the_word_filter_loses_nothing(spark, licences):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = license_scan.paragraphs(docs).select("doc_id", license_scan.words(F.col("line")).alias("w"))
    every = licences.with_probabilities(lines.select("doc_id", licences.known(license_scan._grams("w")).alias("grams")))
    best = F.array_max(F.slice("p", 2, len(license_scan.FAMILIES)))
    found = {r.doc_id for r in every.where(best > licences.least).select("doc_id").collect()}
    got = license_scan.scan_licences(docs, licences).where("n_paragraphs > 0").select("doc_id").collect()
    assert len(found) > 20 and found == {r.doc_id for r in got}


def test_wrapped_and_several_licences(spark, licences):
    mit = " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License"
    rows = [(1, f"First line\n{mit}\nEnd"), (2, f"{prose(3, 30)}\n\n{gpl}"), (3, f"{mit}\n\n{gpl}"), (4, prose(5, 60))]
    got = {r.doc_id: r for r in license_scan.scan_licences(table(spark, rows), licences).collect()}
    assert {i: r.licences for i, r in got.items()} == {1: ["mit"], 2: ["gpl"], 3: ["gpl", "mit"], 4: []}
    assert [got[i].licence for i in (1, 2, 4)] == ["mit", "gpl", "none"]


def test_odd_rows_have_no_licence(spark, licences):
    rows = ODD + [(1, "Licensed under the MIT license."), (2, "text\nAll rights reserved.\n" + LONG), (2, "again"), (None, "All rights reserved.")]
    got = license_scan.scan_licences(table(spark, rows), licences).collect()
    assert sorted((r.doc_id or -1, r.licence) for r in got) == sorted(
        ((i or -1), {1: "mit", 2: "proprietary"}.get(i, "none")) for i, _ in rows)
    assert license_scan.scan_licences(table(spark, []), licences).count() == 0


# --- conversations ------------------------------------------------------------


def test_trees(spark):
    """Random forests: every path by brute force, ranked by score."""
    pick, rows = random.Random(5), []
    for c in range(30):
        for m in range(pick.randint(1, 40)):
            parent = pick.choice([None, *range(m)]) if m else None
            rows.append((c, m, parent, pick.choice(["user", "assistant"]), f"text {m}", pick.choice([None, 1.0, 2.5, -1.0])))
    rows += [(99, 0, 1, "user", "circle", 1.0), (99, 1, 0, "user", "circle", 1.0), (98, 5, 77, "user", "lost parent", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    by = {(r[0], r[1]): r for r in rows}
    want = set()
    for c in {r[0] for r in rows} - {99}:
        parents = {r[2] for r in rows if r[0] == c}
        paths = []
        for m in [r[1] for r in rows if r[0] == c and r[1] not in parents]:
            path, at = [], m
            while (c, at) in by:
                path.append(at)
                at = by[c, at][2]
            paths.append((-sum(by[c, x][5] or 0 for x in path), m, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(paths)[:3], 1):
            want |= {(c, rank, leaf, -score, d, x) for d, x in enumerate(path)}
    got = chat_trees.ranked_paths(df, keep=3).select("conv_id", "branch", "leaf_id", "path_score", "depth", "message_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


HOSTILE = [r"\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "\\l\\b\\h\\\\", "", None, "a\\", "#<:\\", "𝔘 ü\n\n", "</turn>\n" * 5]


def test_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([(r, t) for t in HOSTILE for r in ("user", "assistant", "tool: <x>#\\", None)])]
    rows += [(2, 0, "assistant", "only"), (3, 0, "user", LONG), (None, 0, "user", "no conversation"), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, None, "user", "first")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message_id string")
    out = {r.conv_id: r for r in chat_trees.format_paths(chat_trees.ranked_paths(chat_trees.chains(df))).withColumn(
        "turns", chat_trees.parsed_turns(F.col("formatted"))).withColumn(
        "learned", chat_trees.learned_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(out) == {1, 2, 3, 4}
    assert [tuple(t) for t in out[1].turns] == [(r or "", t or "") for _, _, r, t in rows[: out[1].n_turns]]
    assert out[1].learned == "".join(t or "" for _, _, r, t in rows if r == "assistant" and t != "only")
    assert out[1].formatted.count("</turn>\n") == out[1].n_turns == out[1].formatted.count("### ")
    assert [t.text for t in out[4].turns] == ["first", "tie", "tie"] and out[3].turns[0].text == LONG
    assert chat_trees.conversation_digests(df.where("false")).count() == 0


def test_digest_of_the_added_conversation(spark):
    row = QUERIES["op7_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    want = duckdb.sql(f"select sha256('{text}'), sha256(concat('user', chr(10), '{text}', chr(10), 'assistant', chr(10), '{text}', chr(10)))").fetchall()[0]
    assert (row.loss_sha256, row.turns_sha256) == want


def test_sketches_smaller_than_items_find_what_the_exact_join_finds(spark):
    """Items of all sizes, held to between half and all of their words: recall against brute force, and nothing else."""
    pick = random.Random(8)
    items = [(i, " ".join(words(3000 + i, pick.choice([8, 14, 20, 30, 50, 80, 200])))) for i in range(60)]
    rows = []
    for k in range(300):
        own = items[k % 60][1].split()
        cut = int(len(own) * pick.choice([0.5, 0.7, 0.84, 0.9, 1.0]))
        at = pick.randint(0, len(own) - cut)
        rows.append((k, f"{prose(k, 60)} {' '.join(own[at: at + cut])} {prose(5000 + k, 60)}"))
    sizes = spark.range(1, 300).select(decontamination.sketch_size(F.col("id")).alias("k"), "id").collect()
    assert any(r.k < r.id <= 24 for r in sizes) and any(r.k < r.id <= 64 for r in sizes)
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontamination.contained_items(table(spark, rows), df).collect()}
    want = contained(rows, items)
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100
    assert got == want
