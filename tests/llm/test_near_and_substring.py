import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, ODD, prose, table, words
from pyspark.sql import functions as F

from gradewell.llm import common, dealing, near_dedup, packing, substring_dedup
from gradewell.llm.near_dedup import drop_near_duplicates, near_duplicates


def shingle_set(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, percent=80):
    sets = {i: shingle_set(t, size) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def edited(text, seed, edits):
    pick, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[pick.randrange(len(w))] = f"edit{seed}x{pick.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def family():
    """Exact copies, near copies of every distance, chains, and unrelated texts."""
    base = prose(1, 150)
    rows = [(i, base) for i in range(5, 25)]
    rows += [(100 + i, edited(base, i, i % 12)) for i in range(90)]
    step = prose(2, 100)
    for i in range(6):
        rows.append((300 + i, step))
        step = edited(step, 500 + i, 2)
    return rows + [(400 + i, prose(1000 + i, 60)) for i in range(30)] + [(450 + i, f"short {i % 2}") for i in range(4)]


@pytest.mark.parametrize("size", [4, 5])
def test_components_are_those_of_brute_force(spark, family, size):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, family), size).collect()}
    assert got == brute_components(family, size)


def test_family_larger_than_a_small_bucket_without_rounds(spark, family, monkeypatch):
    """The prefix step alone finds what the rounds of centres leave."""
    real = common.link_in_buckets
    monkeypatch.setattr(near_dedup, "link_in_buckets", lambda *a: real(*a, rounds=0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, family), 4).collect()}
    assert got == brute_components(family, 4)


def test_odd_rows(spark):
    rows = ODD + [(1, LONG), (2, "x " * 40)]
    got = near_duplicates(table(spark, rows), 4).collect()
    assert len(got) == len([r for r in rows if r[0] is not None])
    want = brute_components([r for r in rows], 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = drop_near_duplicates(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 900, 901, 902, 903, 904, 906, 907]
    assert near_duplicates(table(spark, []), 4).count() == drop_near_duplicates(table(spark, [])).count() == 0


def test_chains_end_at_the_smallest_id(spark):
    pairs = spark.range(200).select((F.col("id") * 7 % 200).alias("a"), ((F.col("id") + 1) * 7 % 200).alias("b"))
    assert {r.label for r in common.components(pairs).collect()} == {0}
    assert common.components(pairs.where("false")).count() == 0


def test_estimate_is_close(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8):
        both = rng.integers(1, 2**63, 3000).astype(np.uint64)
        cut = int(3000 * (1 - j) / 2)
        a, b = np.unique(both[cut:]), np.unique(both[: 3000 - cut])
        e = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(e - j) < 5 * (j * (1 - j) / near_dedup.BUCKETS) ** 0.5


# --- passages -----------------------------------------------------------------


def test_passages_inside_lines_and_as_lines(spark):
    passage = prose(7, 60).replace("\n", " ")
    rows = [(1, f"{prose(11, 40)}\n{passage}\n{prose(12, 40)}"), (2, f"{prose(21, 40)} {passage} {prose(22, 40)}"),
            (3, f"{prose(31, 30)}\n{passage}"), (4, prose(41, 80)), (5, edited(passage, 3, 1))]
    out = {r.doc_id: r.text for r in substring_dedup.drop_repeated(table(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[4] == rows[3][1]
    assert passage not in out[2] and passage not in out[3] and len(out[3]) < len(rows[2][1]) - 250
    assert out[2].startswith(rows[1][1][:200]) and out[2].endswith(rows[1][1][-150:])
    assert out[5] == ""


def test_short_shared_lines_stay(spark):
    rows = [(i, f"A heading of ten words that many of them share.\n{prose(50 + i, 40)}") for i in range(8)]
    assert sorted(r.text for r in substring_dedup.drop_repeated(table(spark, rows)).collect()) == sorted(t for _, t in rows)


def test_passages_that_begin_inside_sentences(spark):
    """Every run of twenty words stays in one place only, wherever lines and sentences end."""
    passage, lead = " ".join(words(7, 65)), " ".join(words(6, 25))
    # With its lead the second sentence is not 0.8 alike the first, so only its run of words goes.
    rows = [(1, f"{prose(11, 40)} But here {passage} and on. {prose(12, 40)}"), (2, f"{prose(21, 40)}\nSo {lead} {passage}, it said.\n{prose(22, 40)}"),
            (3, f"{passage[: len(passage) // 2]}\n{passage[len(passage) // 2:]}"), (4, " ".join(words(8, 7) * 20)), (6, "first row of an id"), (6, f"a b c {' '.join(words(7, 65)[10:60])}")]
    rows += [(10 + i, f"{prose(30 + i, 30)} x{i} {' '.join(words(9, 90)[3 * i: 3 * i + 20 + i])} y{i} {prose(60 + i, 30)}") for i in range(20)]
    got = [(r.doc_id, r.text) for r in substring_dedup.drop_repeated(table(spark, rows)).orderBy("doc_id").collect()]
    out = dict(got)
    assert out[1] == rows[0][1] and out[2].startswith(f"{prose(21, 40)}\nSo {lead} ") and out[2].endswith(f"said.\n{prose(22, 40)}")
    assert len(out[2].split()) < len(rows[1][1].split()) - 60 and len(out[3].split()) < 35 and len(out[4].split()) == 20
    assert sorted(t for i, t in got if i == 6) == ["a b c", "first row of an id"]
    runs = [tuple(w[k: k + 20]) for w in (t.lower().split() for _, t in got) for k in range(len(w) - 19)]
    before = {tuple(w[k: k + 20]) for w in (t.lower().split() for _, t in rows) for k in range(len(w) - 19)}
    assert len([r for r in runs if r in before]) == len({r for r in runs if r in before})
    assert {w for _, t in rows for w in t.lower().split()} == {w for _, t in got for w in t.lower().split()}


def test_lines_of_brute_force(spark):
    """Lines whose shingle sets are 0.8 alike, in chains: all but the first go."""
    lines = [prose(200 + i, 35, 40) for i in range(10)]
    lines += [edited(lines[i % 10], 70 + i, i % 4) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(lines)]
    want = brute_components(rows, 5)
    out = {r.doc_id: r.text for r in substring_dedup.drop_repeated(table(spark, rows)).collect()}
    assert {i for i, t in out.items() if t == ""} == {i for i, (_, label) in want.items() if label != i}


def test_changed_sentences_inside_one_line(spark):
    """Sentences whose first word was changed are 0.8 alike: they go as lines and inside a longer line."""
    def sentence(i, first):
        own = words(500 + i, 19)
        return " ".join([first, *own[1:]]) + "."
    whole, other = ([sentence(i, f"{w}{i}") for i in range(6)] for w in ("old", "new"))
    rows = [(1, " ".join(whole)), (2, " ".join(["Twenty words of its own come first here.", *other, prose(77, 24, 24)])), (3, "\n".join(other[:4] + [prose(78, 30)]))]
    out = {r.doc_id: r.text for r in substring_dedup.drop_repeated(table(spark, rows)).collect()}
    assert out[1] == rows[0][1]
    assert out[2] == "Twenty words of its own come first here. " + prose(77, 24, 24) and out[3] == prose(78, 30)


def test_sentences_of_brute_force(spark):
    """In chains of sentences 0.8 alike, each inside a line of its own words, all but the first go."""
    base = [words(700 + i, pick) for i, pick in enumerate([20, 22, 26, 31, 40, 47])]
    rows, own = [], {}
    for i in range(36):
        w = list(base[i % 6])
        for k in range(i // 6 % 3):
            w[k] = f"z{i}"
        own[i] = " ".join(w) + "."
        rows.append((i, f"{prose(900 + i, 9)} {own[i]} {prose(950 + i, 9)}"))
    want = brute_components([(i, t) for i, t in own.items()], 5)
    out = {r.doc_id: r.text for r in substring_dedup.drop_repeated(table(spark, rows)).collect()}
    assert {i for i in own if own[i].split()[10] not in out[i].split()} == {i for i, (_, label) in want.items() if label != i}


def words_of_repeated_runs(texts, size=20):
    """By definition: every run of ``size`` words but the first one with these words, less what overlaps its own first one."""
    first, gone = {}, {}
    for i, text in sorted(texts.items()):
        own = text.lower().split()
        for place in range(len(own) - size + 1):
            run = tuple(own[place: place + size])
            j, at = first.setdefault(run, (i, place))
            if (j, at) != (i, place):
                start = max(place, at + size) if j == i else place
                gone.setdefault(i, set()).update(range(start, place + size))
    return {i: w for i, w in gone.items() if w}


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_brute_force(spark, seed):
    pick = random.Random(seed)
    vocabulary = words(seed, 300) if seed % 2 else ["a", "b"]
    passages = [[pick.choice(vocabulary) for _ in range(pick.randint(15, 70))] for _ in range(8)]
    passages += [[pick.choice(vocabulary)] * 90, passages[0][:30] + passages[1][-25:], passages[2][5:31]]
    texts = {}
    for i in range(60):
        own = []
        for _ in range(pick.randint(0, 5)):
            own += [pick.choice(vocabulary) for _ in range(pick.randint(0, 25))]
            passage = list(pick.choice(passages))
            if pick.random() < 0.4:
                passage[pick.randrange(len(passage))] = f"new{i}"
            own += passage[pick.randrange(6):]
        texts[i] = pick.choice([" ", "\n"]).join(own) + f" end{i}"
    got = {}
    for r in substring_dedup.repeated_runs(substring_dedup.distinct_texts(table(spark, list(texts.items())))[0]).collect():
        got.setdefault(r["doc_id"], set()).update(k for run in r["runs"] for k in range(run["start"], run["end"]))
    assert got == words_of_repeated_runs(texts)


def test_hashes_do_not_depend_on_longer_neighbours():
    """The same words and runs beside a word of 5,000 letters and a line of 5,000 words."""
    from gradewell.llm.hashing import Words, run_hashes

    text = prose(3, 40)
    alone, beside = Words([text]), Words([text, "x" * 5000, " ".join(["y"] * 5000)])
    assert (alone.hashes == beside.hashes[: len(alone.hashes)]).all()
    assert (run_hashes(alone.hashes, [0, 20]) == run_hashes(beside.hashes, [0, 20, 40])[:2]).all()


def test_copied_places_are_not_compared(spark, monkeypatch):
    """Of a passage in forty texts only places with other words around them get their sides."""
    rows, real = {}, substring_dedup.materialize

    def counted(df, path=None, label="rows"):
        out = real(df, path, label=label)
        rows[label] = out.count()
        return out
    passage = " ".join(words(7, 400))
    texts = substring_dedup.distinct_texts(table(spark, [(i, f"{prose(100 + i, 30)} {passage} {prose(300 + i, 30)}") for i in range(40)]))[0]
    monkeypatch.setattr(substring_dedup, "materialize", counted)
    cut = {r.doc_id: r.runs for r in substring_dedup.repeated_runs(texts).collect()}
    assert sorted(cut) == list(range(1, 40)) and rows["anchor-places"] < 40 * 10 < rows["anchors"] / 4


def test_texts_are_read_once_for_sets(spark, monkeypatch):
    """A family of near copies goes through all rounds; their sets come from one pass over the texts."""
    made, real = [], substring_dedup.materialize

    def counted(df, path=None, label="rows"):
        made.append(label)
        return real(df, path, label)

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    line = prose(41, 40)
    rows = [(i, edited(line, 700 + i, i % 6)) for i in range(40)]
    substring_dedup.repeated_units(substring_dedup.distinct_texts(table(spark, rows))[0]).collect()
    assert made.count("unit-sets") == 1


def test_buckets_of_two_know_the_other(spark):
    rows = [(1, 10), (1, 11), (2, 10), (2, 10), (3, 10), (3, 11), (3, 12), (4, 10), (4, 10), (4, 13), (None, 1), (None, 2)]
    got = common.open_members(spark.createDataFrame(rows, "key long, id long")).collect()
    assert sorted((r.key, r.id, r.other) for r in got if r.other is not None) == [(1, 10, 11), (1, 11, 10)]
    assert sorted((r.key, r.id) for r in got if r.other is None) == [(3, 10), (3, 11), (3, 12), (4, 10), (4, 13)]


def test_equal_units_of_a_part_are_sketched_once(spark):
    line = prose(42, 30)
    units = table(spark, [(i, f"{line}\n{prose(800 + i, 20)}") for i in range(6)]).coalesce(1).selectExpr("doc_id as t", "text")
    units = units.mapInArrow(substring_dedup._units, substring_dedup._UNITS).collect()
    sketched = [r.h for r in units if r["keys"] is not None]
    assert len(sketched) == len(set(sketched))
    lines = [r.h for r in units if r["at"] % 2 == 0]
    assert set(lines) <= set(sketched) and len(lines) > len(set(lines))


def test_texts_are_not_shuffled_for_what_is_asked_of_them(spark, settings):
    """Texts lie in buckets of their key: sets and surroundings are made without another shuffle of them."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    rows = [(i, prose(900 + i, 20)) for i in range(30)] + [(90, prose(900, 20)), (3, prose(903, 20)), (3, prose(950, 20))]
    texts, copies = substring_dedup.distinct_texts(table(spark, rows))
    assert sorted((r.doc_id, r.text) for r in texts.collect()) == sorted(rows[:30] + rows[-1:]) and [r.doc_id for r in copies.collect()] == [90]
    asked = texts.where("t % 2 = 0").selectExpr("t", "array(t) as wanted")
    got = substring_dedup._asked_texts(texts, asked)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    shuffled = [step for step in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", step.strip())]
    assert shuffled and not any("text#" in step for step in shuffled)
    want = {r.t: r.text for r in texts.collect() if r.t % 2 == 0}
    assert {r.t: r.text for r in got.collect()} == want and all(r.wanted == [r.t] for r in got.collect())


def test_shares_hold_all_rows_of_a_key(spark):
    """Keys that come once, twice and 9,000 times, in several tasks; few Spark rows are shuffled."""
    keys = [7] * 9000 + list(range(100, 9000)) + list(range(100, 9000, 9))
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, id long").repartition(4)

    def counted(key, ids):
        rows = dealing.repeated(key)
        found, n = np.unique(key[rows], return_counts=True)
        return pa.table({"key": found, "n": n.astype(np.int64)})

    got = dealing.by_key(df, ["key", "id"], counted, "key long, n long").collect()
    want = {k: n for k, n in Counter(keys).items() if n > 1}
    assert len(got) == len(want) and {r.key: r.n for r in got} == want
    shares = dealing.SHARES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert df.mapInArrow(dealing._deal(None, ["c0", "c1"], shares), "share int, c0 binary, c1 binary").count() <= 4 * shares


def test_odd_rows_keep_their_columns(spark):
    rows = ODD + [(1, LONG)]
    df = table(spark, rows)
    out = substring_dedup.drop_repeated(df)
    assert out.schema == df.schema
    got = sorted(((r.doc_id or -1), r.text) for r in out.collect() if r.text is not None)
    want = sorted(((i or -1), "" if i == 905 else t) for i, t in rows if t is not None)
    assert got == want and out.where("text is null").count() == 1
    assert substring_dedup.drop_repeated(table(spark, [])).count() == 0


# --- packing ------------------------------------------------------------------


def test_bins_hold_every_piece_once():
    import numpy as np
    for seed in range(5):
        lengths = np.random.default_rng(seed).integers(1, 101, 500)
        histogram = np.bincount(lengths, minlength=101)
        plan = packing.plan_bins(histogram, 100)
        held = np.zeros(101, int)
        for bin_, n in plan:
            assert sum(bin_) <= 100
            np.add.at(held, bin_, n)
        assert (held == histogram).all()
        least = max(-(-lengths.sum() // 100), (lengths > 50).sum())
        assert sum(n for _, n in plan) <= least * 1.02 + 1


def test_small_cases_are_optimal():
    import itertools

    import numpy as np

    def best(items, room):
        for bins in range(1, len(items) + 1):
            for place in itertools.product(range(bins), repeat=len(items)):
                if all(sum(x for x, p in zip(items, place) if p == b) <= room for b in range(bins)):
                    return bins

    for seed in range(30):
        items = np.random.default_rng(seed).integers(1, 10, 6)
        assert sum(n for _, n in packing.plan_bins(np.bincount(items, minlength=11), 10)) == best(items.tolist(), 10)


def test_pieces_are_the_tokenizers_ids(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    rows = ODD + [(i, prose(i, 20 + 37 * i)) for i in range(40)] + [(50 + i, "copy of a text") for i in range(30)]
    got = packing.pack(table(spark, rows), path, 256, with_ids=True).collect()
    by_sequence, tokenizer = {}, Tokenizer.from_file(path)
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert sum(r.length for r in own) <= 256
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    import numpy as np
    want = sorted((i or -1, *np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tolist()) for i, t in rows)
    docs, text = [], []
    for r in sorted(got, key=lambda r: (r.doc_id or -1, r.piece, r.sequence_id, r.offset)):
        if r.doc_id == 906:
            docs.append((906, *np.frombuffer(r.ids, "<u4").tolist()))
            continue
        if r.piece == 0:
            docs.append((r.doc_id or -1,))
        assert r.start == len(docs[-1]) - 1 and (r.length == 256 or r.length < 256)
        docs[-1] += tuple(np.frombuffer(r.ids, "<u4").tolist())
    assert sorted(docs) == want and not text
    assert packing.pack(table(spark, []), path).count() == 0

def exact_bins(items: list[int], capacity: int) -> int:
    """Fewest bins, by trying every place of every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def planned_bins(items: list[int], capacity: int) -> int:
    histogram = [0] * (capacity + 1)
    for i in items:
        histogram[i] += 1
    import numpy as np
    plan = packing.plan_bins(np.array(histogram), capacity)
    assert sorted(x for b, n in plan for x in b * n) == sorted(items) and all(sum(b) <= capacity for b, _ in plan)
    n = sum(n for _, n in plan)
    assert packing.least_bins(np.array(histogram), capacity) <= n
    return n


def test_many_small_cases_are_optimal():
    assert planned_bins([39, 52, 58, 47, 58, 43, 14, 32, 14, 21, 13], 100) == 4
    assert planned_bins([5, 5, 5, 5], 4 + 6) == 2 and planned_bins([10, 5, 4, 4, 2], 20) == 2
    pick = random.Random(6)
    for _ in range(400):
        capacity = pick.choice([10, 30, 100])
        items = [pick.randint(1, max(1, capacity * pick.choice([3, 6, 9]) // 10)) for _ in range(pick.randint(1, 11))]
        assert planned_bins(items, capacity) == exact_bins(items, capacity)


def test_fillings_are_undominated():
    import numpy as np
    left = np.zeros(11, np.int64)
    left[[5, 2]] = 1
    left[4] = 2
    found = packing.fillings(left, 10, 10)
    assert found[0] == ([4, 4, 2], 0) and ([5, 4], 1) in found and all(sorted(f) != [2, 5] for f, _ in found)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_hostile_texts_get_the_tokenizers_ids(name):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    pick, tokenizer = random.Random(1), Tokenizer.from_file(public_tokenizers.path(name))
    signs = [*"abcXYZ .,;:!?%$#&*|~<>|'0 1\t\n\r\x0b\x0c\x1c\x1d\x1f\x85", "İ", "ß", "Σ", "ς", "ǅ", "ﬁ", "é", "é", "́", "क़", " ",
             "　", "​", "ñ", "Å", "Ω", "½", "中", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'S", "'ll", "K", "ſ", "the", "The.", "ẞ", "ͅ", "ᾳ"]
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 30))) for _ in range(5000)] + ["İ.", "İ%", "word, İ,", None, ""]
    for text, found in zip(texts, packing.token_ids(texts, public_tokenizers.path(name)), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
