"""Language of a text by character language models, with calibrated rejection.

Every language of the labelled documents has an interpolated Kneser-Ney model
(``charlm``); a text belongs to the one with the lowest cross-entropy per
character.  All labelled documents together set how fast the score rises with the
distance to the next language, and from which cross-entropy on a text is flagged
as none of the known ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.charlm import WORD, CharModel, StoredModel, learn
from gradewell.llm.hashing import pieces
from gradewell.session import materialize

UNKNOWN = "und"
#: Share of labelled documents of a language that may be flagged.
REJECTED = 0.001
#: Labelled documents below which a language has no limit.
MIN_LABELLED = 20


@dataclass
class LanguageModel:
    model: CharModel | StoredModel
    sharpness: float
    limits: np.ndarray


def entropies(texts: list[str | None], model: CharModel) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text in each language, and its characters."""
    index: dict[str, int] = {}
    places, sizes = [], []
    for t in texts:
        own = [index.setdefault(w, len(index)) for w in WORD.findall((t or "").lower())]
        places.append(np.array(own, np.int64))
        sizes.append(len(own))
    scores, grams = model.word_scores(list(index))
    total, chars = np.zeros((len(texts), len(model.groups))), np.zeros(len(texts), np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        place = np.concatenate(places)
        starts = (np.cumsum(sizes) - sizes)[filled]
        total[filled] = np.add.reduceat(scores[place].astype(np.float64), starts, axis=0)
        chars[filled] = np.add.reduceat(grams[place], starts)
    return -total / np.maximum(chars, 1)[:, None], chars


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _scored(model: CharModel | None):
    """Id, group and measures of rows; without a model their entropies and characters come with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            for part in pieces(texts):
                if model is None:
                    found, chars = (batch.column(c).slice(at, len(part)) for c in (3, 4))
                else:
                    values, n = entropies(part, model)
                    found, chars = pa.array(list(values), pa.list_(pa.float64())), pa.array(n)
                letters = [n > 0 and _has_letter(t) for t, n in zip(part, chars.to_pylist())]
                own = [batch.column(c).slice(at, len(part)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, found, chars, pa.array(letters, pa.bool_())], ["doc_id", "grp", "entropies", "chars", "letters"])
                at += len(part)
    return run


def _row_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, at = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
        for part in pieces(texts):
            own = [Counter(WORD.findall((t or "").lower())) for t in part]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(rows[at: at + len(part)], [len(c) for c in own])), pa.array([w for c in own for w in c], pa.string()),
                pa.array([n for c in own for n in c.values()], pa.int64())], ["row", "word", "n"])
            at += len(part)


def stored_entropies(rows: DataFrame, model: StoredModel) -> DataFrame:
    """``rows`` (with ``text``) and their ``entropies`` and ``chars``, as ``entropies`` has them, by joins with distinct words."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), label="numbered-texts")
    words = materialize(rows.select("row", "text").mapInArrow(_row_words, "row long, word string, n long"), label="text-words")
    scored = words.join(materialize(model.word_scores(words), label="word-scores"), "word")
    total = F.array(*[-F.sum(F.col("n") * F.col("logs")[j]) / F.sum(F.col("n") * F.col("chars")) for j in range(len(model.groups))])
    found = scored.groupBy("row").agg(total.alias("entropies"), F.sum(F.col("n") * F.col("chars")).alias("chars"))
    none = F.array_repeat(F.lit(0.0), len(model.groups))
    return rows.join(found, "row", "left").drop("row").withColumns({"entropies": F.coalesce("entropies", none), "chars": F.coalesce("chars", F.lit(0).cast("long"))})


def measured(rows: DataFrame, model: CharModel | StoredModel) -> DataFrame:
    """``doc_id, grp, entropies, chars, letters`` of ``rows`` (``doc_id, grp, text``); ``letters``: the text holds one."""
    rows, schema = rows.select("doc_id", "grp", "text"), "doc_id long, grp string, entropies array<double>, chars long, letters boolean"
    if isinstance(model, StoredModel):
        with_values = stored_entropies(rows, model).select("doc_id", "grp", "text", "entropies", "chars")
        return with_values.mapInArrow(_scored(None), schema)
    return rows.mapInArrow(_scored(model), schema)


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where("grp is not null and text is not null")


def train(labelled: DataFrame) -> LanguageModel | None:
    """Models of all languages in ``labelled`` (``text, lang``); none without a labelled text that holds a letter.

    Counts and calibration cover every row.
    """
    text, grp = F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("grp")
    rows = _labelled(labelled.select(F.lit(None).cast("long").alias("doc_id"), grp, text))
    model = learn(rows)
    return None if model is None else calibrate(materialize(measured(rows, model), label="entropies"), model)


def calibrate(rows: DataFrame, model: CharModel | StoredModel) -> LanguageModel:
    """What all of ``rows`` (stored, as ``measured`` has them) with a group say of limits and sharpness.

    Only sums over the rows and a row for each language come to the driver.
    """
    place = F.array_position(F.array(*[F.lit(g) for g in model.groups]), F.col("grp"))
    known = rows.where("grp is not null and chars > 0").withColumn("place", place).where("place > 0")
    known = known.withColumn("own", F.element_at("entropies", F.col("place").cast("int")))
    limits = np.full(len(model.groups), np.inf)
    for grp, value in highest_usual(known.select("grp", "own")).items():
        limits[model.groups.index(grp)] = value * 1.02
    # Sums of whole numbers are the same in any order.
    least, choices = F.array_min("entropies"), [2.0 ** k for k in range(8)]
    likelihoods = [F.greatest(F.log(_share("entropies", "own", s)), F.lit(np.log(1e-6))) for s in choices]
    sums = known.withColumn("least", least).agg(*[F.sum(F.round(x * 2 ** 20).cast("long")) for x in likelihoods]).first()
    best = max(range(len(choices)), key=lambda k: (sums[k], -k)) if sums[0] is not None else 0
    return LanguageModel(model, choices[best], limits)


def _share(entropies: str, own: str, sharpness: float) -> Column:
    """Share among all languages of the one with the cross-entropy ``own``; ``least`` is the lowest of all."""
    weight = lambda x: F.exp((F.col("least") - x) * sharpness)
    return weight(F.col(own)) / F.aggregate(entropies, F.lit(0.0), lambda total, x: total + weight(x))


def highest_usual(rows: DataFrame) -> dict[str, float]:
    """By ``grp`` the lowest value of ``own`` (at least 0) that no more than the share REJECTED of the rows exceed.

    It is found among all rows by counts in ever finer bins, of which only that
    with the sought rank is looked into further; the last are 2**-44 wide.  Groups of
    fewer than MIN_LABELLED rows have none.
    """
    found: dict[str, float] = {}
    want: dict[str, tuple[int, int | None]] = {}
    for bits in (8, 20, 32, 44):
        binned = rows.withColumn("bin", F.floor(F.col("own") * 2.0 ** bits))
        if bits > 8:
            if not want:
                break
            inside = F.create_map(*[F.lit(x) for g, (_, b) in want.items() for x in (g, b)])
            binned = binned.where(F.floor(F.col("own") * 2.0 ** (bits - 12)) == inside[F.col("grp")])
        counts = binned.groupBy("grp", "bin").agg(F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
        here = Window.partitionBy("grp")
        counts = counts.withColumns({"upto": F.sum("n").over(here.orderBy("bin")), "total": F.sum("n").over(here)})
        if bits == 8:
            rank = F.col("total") - F.floor(F.col("total") * REJECTED)
            counts = counts.where(F.col("total") >= MIN_LABELLED)
        else:
            rank = F.create_map(*[F.lit(x) for g, (k, _) in want.items() for x in (g, k)])[F.col("grp")]
        counts = counts.withColumn("rank", rank).where("upto >= rank and upto - n < rank")
        want = {}
        for r in counts.select("grp", "bin", "low", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rest")).collect():
            if r["low"] == r["high"] or bits == 44:
                found[r["grp"]] = r["high"]
            else:
                want[r["grp"]] = r["rest"], r["bin"]
    return found


def predicted(rows: DataFrame, trained: LanguageModel) -> DataFrame:
    """``rows`` as ``measured`` has them, with ``lang_pred, score, cross_entropy, rejected``."""
    names, limits = (F.array(*[F.lit(x) for x in values]) for values in (trained.model.groups, trained.limits.tolist()))
    rows = rows.withColumn("least", F.array_min("entropies"))
    best = F.array_position("entropies", F.col("least")).cast("int")
    return rows.withColumns({
        "lang_pred": F.when(F.col("letters"), F.element_at(names, best)).otherwise(UNKNOWN),
        "score": F.when(F.col("letters"), _share("entropies", "least", trained.sharpness)).otherwise(0.0),
        "cross_entropy": F.when(F.col("letters"), F.col("least")).otherwise(float("nan")),
        "rejected": F.col("letters") & (F.col("least") > F.element_at(limits, best)),
    }).drop("least")


def _nothing_learned(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(float("nan")), "rejected": F.lit(False)})


_RESULT = ["lang_pred", "score", "cross_entropy", "rejected"]


def identify(docs: DataFrame, trained: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` for every row of ``docs`` (``doc_id, text``).

    ``und`` with score 0 where the text is null or holds no letter, or nothing
    was learned.  ``score`` is the share of the language among all, from the
    cross-entropies; ``rejected`` marks a text less usual than nearly all
    labelled texts of its language.  Rows without an id and repeated rows are
    rows like others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("grp"), F.col("text").cast("string").alias("text"))
    out = _nothing_learned(rows) if trained is None else predicted(measured(rows, trained.model), trained)
    return out.select("doc_id", *_RESULT)


def fold(doc_id: str, folds: int) -> Column:
    """Fold of an id: the crc32 of its text, modulo; a null id is as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Languages of all documents, learned from those outside fold 2 of 4.

    Every document is measured once, for the calibration and for its prediction.
    """
    learned_from = F.when(fold("doc_id", 4) != 2, F.col("lang").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), learned_from.alias("grp"), F.col("text").cast("string").alias("text"))
    model = learn(_labelled(rows))
    if model is None:
        out = _nothing_learned(rows)
    else:
        stored = materialize(measured(rows, model), label="entropies")
        out = predicted(stored, calibrate(stored, model))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), *_RESULT)
