import zlib

import numpy as np
import pytest
from helpers import LONG, ODD, prose, table
from pyspark.sql import functions as F

import corpus_pipeline
from gradewell.llm import charlm, language_id, near_dedup, quality, sharding, substring_dedup, toxicity
from gradewell.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"

# --- character models and languages -------------------------------------------


def test_gram_keys_of_words():
    keys, sizes = charlm.gram_keys(["ab", "é"])
    assert sizes.tolist() == [3, 2]
    text = ["\x02\x02\x02ab\x03", "\x02\x02\x02é\x03"]
    want = [sum(ord(c) << (48 - 16 * k) for k, c in enumerate(w[i: i + 4])) for w in text for i in range(len(w) - 3)]
    assert keys.tolist() == want


def test_probabilities_sum_to_one(spark):
    rows = [(i, prose(i, 80), "ab"[i % 2]) for i in range(20)] + [(90, None, "a"), (91, "...", "c")]
    counts = charlm.gram_counts(table(spark, rows).select(F.col("lang").alias("grp"), "text"))
    assert sorted(counts) == ["a", "b"]
    model = charlm.kneser_ney(counts)
    letters = sorted({c for _, t, *_ in rows for c in (t or "").lower() if c.isalpha()})
    for head in ("the", "zz\x02", "\x02\x02\x02", "qqq"):
        keys = np.array([sum(ord(c) << (48 - 16 * k) for k, c in enumerate(head + x)) for x in [*letters, "\x03"]], np.uint64)
        assert np.allclose(np.exp(model.score(keys).astype(float)).sum(axis=0), 1, atol=0.02)


def test_one_gram_is_scored_as_many(spark):
    rows = [(i, prose(i, 80)) for i in range(20)]
    model = charlm.kneser_ney(charlm.gram_counts(table(spark, rows).select(F.lit("").alias("grp"), "text")))
    keys, _ = charlm.gram_keys([*prose(3, 200).lower().split(), "zzqx", "äöü", "the"])
    assert [model.log(k) for k in keys.tolist()] == model.score(keys)[:, 0].astype(float).tolist()


def test_counts_are_whole(spark):
    rows = [(i, "Ab ab, 3ab" if i % 2 else "b") for i in range(50)]
    keys, n = charlm.gram_counts(table(spark, rows).select(F.lit("").alias("grp"), "text"))[""]
    want = {}
    for _, t in rows:
        for w in charlm.WORD.findall(t.lower()):
            for k in charlm.gram_keys([w])[0].tolist():
                want[k] = want.get(k, 0) + 1
    assert dict(zip(keys.tolist(), n.tolist())) == want


def test_no_gram_is_left_out(spark):
    """More 4-grams than any fixed count, most of them seen once."""
    letters = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i, " ".join(a + b + letters[i] + a for b in letters)) for i, a in enumerate(letters)]
    texts = table(spark, rows, extra=False).select(F.lit("").alias("grp"), "text")
    want = {k for _, t in rows for k in charlm.gram_keys(t.split(" "))[0].tolist()}
    assert len(want) > 200_000
    model = charlm.learn(texts)
    assert len(model.grams[4]) == len(want) and set(charlm.gram_counts(texts)[""][0].tolist()) == want


def test_a_stored_model_says_the_same(spark, monkeypatch):
    rows = [(i, prose(i, 90 + i), "xyz"[i % 3]) for i in range(45)] + ODD
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    texts = rows + [(3000, "th3 1diot s.t.u p i d w0rd aaaand"), (3001, "12 34"), (3002, "qqq ξξξ")]

    def results():
        learned = language_id.train(table(spark, rows))
        tongues = language_id.identify(table(spark, texts), learned).collect()
        model = toxicity.train(table(spark, rows), labels)
        return learned, sorted(tongues, key=str), sorted(toxicity.score(table(spark, texts), model).collect(), key=str)

    sent, tongues, scores = results()
    monkeypatch.setattr(charlm, "SEND_BYTES", 0)
    stored, tongues_2, scores_2 = results()
    assert isinstance(sent.model, charlm.CharModel) and isinstance(stored.model, charlm.StoredModel)
    order = lambda r: (str(r.doc_id), r.lang_pred, round(r.score, 3))
    for a, b in zip(sorted(tongues, key=order), sorted(tongues_2, key=order), strict=True):
        assert (a.doc_id, a.lang_pred, a.rejected) == (b.doc_id, b.lang_pred, b.rejected)
        assert (a.score, a.cross_entropy) == pytest.approx((b.score, b.cross_entropy), abs=1e-4, nan_ok=True)
    order = lambda r: (str(r.doc_id), round(r.score, 4))
    for a, b in zip(sorted(scores, key=order), sorted(scores_2, key=order), strict=True):
        assert a.doc_id == b.doc_id and a.score == pytest.approx(b.score, abs=1e-4)


def test_held_out_languages(spark):
    out = QUERIES["op8_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99 and out.count() == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.collect())


def test_every_labelled_row_is_calibrated_on(spark):
    """Of a thousand rows one may exceed the limit, wherever it lies among more rows than a sample would hold."""
    values = [2 + (i * 7919 % 30_011) / 30_011 for i in range(30_000)] + [9.5] * 31
    data = spark.createDataFrame([("x", v) for v in values] + [("y", 5.25)] * 40 + [("z", 1.0)] * 19, "grp string, own double")
    got = language_id.highest_usual(data.repartition(7))
    assert got == {"x": sorted(values)[len(values) - len(values) // 1000 - 1], "y": 5.25} and got["x"] == 9.5
    learned = language_id.train(table(spark, [(i, f"{prose(i, 30)} {i}", "xy"[i % 2]) for i in range(4200)]))
    rows = [(i, f"{prose(i, 30)} {i}") for i in range(0, 4200, 2)]
    own = language_id.measured(table(spark, rows).select("doc_id", F.lit("x").alias("grp"), "text"), learned.model).collect()
    assert learned.limits[0] == 1.02 * sorted(r.entropies[0] for r in own)[2100 - 2 - 1]


def test_odd_texts_have_no_language(spark):
    learned = language_id.train(table(spark, [(i, prose(i, 90), "xy"[i % 2]) for i in range(12)] + [(50, "no language", None)]))
    rows = ODD + [(1, "12 34 !?"), (2, "½ ²"), (3, "a")]
    got = language_id.identify(table(spark, rows), learned).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902, 1, 2}
    assert language_id.train(table(spark, []).select("text", "lang")) is None
    assert {r.lang_pred for r in language_id.identify(table(spark, ODD), None).collect()} == {"und"}
    assert language_id.identify(table(spark, []), learned).count() == 0


# --- toxicity -----------------------------------------------------------------


def test_the_decoder_finds_the_best_path(spark):
    """Against every path of the lattice."""
    import itertools
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.lit("").alias("grp"), "text")
    model = charlm.kneser_ney(charlm.gram_counts(docs))
    decoder = toxicity.Decoder(model)
    for token in ("th3", "1t", "0n3", "w1th", "thaaat", "a.n.d", "$h3", "t|1s"):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(token)]
        options = []
        for c, n in runs:
            if c.isalpha():
                options.append([(c * n, 0.0)] if n < 3 else [(c, toxicity.REPEATED), (c * 2, toxicity.REPEATED)])
            elif c in toxicity.LEET:
                options.append([(x, toxicity.SIGN) for x in toxicity.LEET[c]] + [("", toxicity.DROPPED)])
            else:
                options.append([("", toxicity.SEPARATOR)])
        def total(path):
            return sum(p[1] for p in path) + float(model.word_scores(["".join(p[0] for p in path)])[0][0, 0])
        best = max(map(total, itertools.product(*options)))
        text = decoder.decode(token)
        reached = max(total(p) for p in itertools.product(*options) if "".join(x[0] for x in p) == text)
        assert reached == pytest.approx(best, abs=1e-3)
    assert decoder.words("plain,") == ["plain"] and decoder.words("###") == []


def test_common_disguises_are_read(spark):
    said = ["useless dumbass kill hate ass idiot stupid you are and letter well known taxi hello moron the of"] * 20
    texts = table(spark, list(enumerate(said))).select(F.lit("").alias("grp"), "text")
    model = charlm.learn(texts)
    disguised = "usele55 dumba55 ki11 hat3 a$$ idio+ id10+ 5.t.u.p.i.d iiddiioott s-t-u-p-i-d kkiillll"
    assert toxicity.restore(disguised, model) == "useless dumbass kill hate ass idiot idiot stupid idiot stupid kill"
    assert sorted(toxicity.restore("now a s s end", model).split()) == ["ass", "end", "now"]
    assert toxicity.restore("y o u i d i o t", model) == "you idiot"
    plain = "letter hello, well-known kill! (useless)"
    assert toxicity.restore(plain, model) == "letter hello well known kill useless"


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(language_id.fold("doc_id", 3) != 1))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(language_id.fold("doc_id", 3) == 1).collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.95 and hit / sum(r.toxic for r in rows) > 0.9
    disguise = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "@"})
    plain = "the stupid idiot and the pathetic moron said it to the worthless loser of the hand"
    texts = [(1, plain), (2, plain.translate(disguise)), (3, plain.replace("idiot", "i d i o t").replace("moron", "moooooron")),
             (4, "the hand and the other was of this and that for it"), *ODD]
    got = {r.doc_id: r for r in toxicity.score(table(spark, texts), model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 1, 1, 0]
    assert got[900].score == got[901].score == got[902].score and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(table(spark, []), model).count() == 0
    none = toxicity.train(docs.limit(5), labels.where("false"))
    assert {r.score for r in toxicity.score(table(spark, ODD), none).collect()} == {0.5}


def test_labels_are_learned_outside_the_fold(spark):
    out = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(r.predicted == int(r.score >= 0.7) for r in out)


# --- shards -------------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 8])
def test_shards(spark, count):
    rows = ODD + [(i, prose(i, 5 + i % 90)) for i in range(400)] + [(1000 + i, prose(7, 30)) for i in range(60)] + [(2000 + i, "few") for i in range(3)]
    got = sharding.shards(table(spark, rows), count).collect()
    want = sorted(((i or -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(((r.doc_id or -1), r.size, r.text_crc32) for r in got) == want
    total, large = sum(w[1] for w in want), max(w[1] for w in want)
    for s in range(count):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    if count > 1:
        # The one very long row takes shards of its own; the others differ by a row at most.
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        sizes = [sum(r.size for r in got if r.shard == s) for s in range(count)]
        assert max(sizes) <= total / count + large
    assert sharding.shards(table(spark, []), count).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, prose(i, 5 + i % 50)) for i in range(3000)] + [(9000 + i, prose(i % 7, 20)) for i in range(70)]
    got = sharding.shards(table(spark, rows)).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    text = dict(rows)
    shards = {}
    for r in got:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


# --- pipeline -----------------------------------------------------------------


def test_stages(spark):
    """Each stage against what its operator says of the same documents."""
    passage = prose(77, 60).replace("\n", " ")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    rows = [(i, prose(i, 120)) for i in range(1, 30)] + [(100, prose(5, 120)), (101, prose(6, 118)), (102, "too short"), (None, prose(200, 90)),
            (103, f"{prose(31, 60)}\n{passage}"), (104, f"{prose(32, 60)}\n{passage}"), (105, f"{prose(33, 60)} {item}"), *ODD]
    df = table(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    good = stages["quality_rules"](spark, df, sf)
    keep = {(r.doc_id, r.n_words) for r in quality.quality(df).collect() if r.kept}
    assert {(r.doc_id, len(r.text.split())) for r in good.collect()} == keep and good.schema == df.schema
    one = stages["near_duplicates"](spark, good, sf)
    gone = {r.doc_id for r in near_dedup.near_duplicates(good, 5).collect() if not r.kept}
    assert {r.doc_id for r in one.collect()} == {i for i, _ in keep} - gone and {100, 101} <= gone
    cut = stages["repeated_passages"](spark, one, sf)
    assert {r.doc_id for r in cut.collect()} == {r.doc_id for r in one.collect()} and cut.schema == df.schema
    assert [passage in r.text for r in cut.where("doc_id in (103, 104)").orderBy("doc_id").collect()] == [True, False]
    clean = stages["benchmark_items"](spark, cut, sf)
    assert {r.doc_id for r in cut.collect()} - {r.doc_id for r in clean.collect()} == {105}
    placed = stages["sequences"](spark, clean, sf)
    assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in clean.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), sf).count() == 0


def test_pipeline_query(spark):
    out = QUERIES["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and corpus_pipeline.ORACLE_SQL is None and "pipeline" not in SQL


def test_units_of_one_text():
    text = "One two three four five six seven eight. Short.\nNext line here has at least eight words in it"
    u = substring_dedup.Units([text, LONG])
    assert u.number[:3].tolist() == [0, 1, 2] and u.line_sizes[:2].tolist() == [9, 10]
    assert substring_dedup.without_units(text, []) == text


def test_workers_keep_what_they_have_read(spark):
    """From task to task, although the package travels by value."""
    from gradewell.llm.workers import kept

    def run(batches):
        import pyarrow as pa

        own = kept("test")
        for batch in batches:
            own["rows"] = own.get("rows", 0) + batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([own["rows"]])], ["n"])

    counts = [r.n for r in spark.range(0, 4000, 1, 40).mapInArrow(run, "n long").collect()]
    assert max(counts) > 100
