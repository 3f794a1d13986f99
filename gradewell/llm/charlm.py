"""Character language models: interpolated Kneser-Ney over the words of texts.

Counts of all character 4-grams are taken in the tasks and summed by Spark; lower
orders follow from them.  A model holds, for several groups of texts at once, the
interpolated probability of every 4-, 3-, 2- and 1-gram seen, and the weight of
every context for grams that were not.  Up to SEND_BYTES it is made of arrays
sorted by the hash of the gram, which go to the tasks; a larger one is made of
tables, and the grams of distinct words are joined with them.  Both hold the same.
Words are runs of letters in lower case with three marks before and one behind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.hashing import mix, mix_one, pieces
from gradewell.session import materialize

ORDER = 4
#: Size of the 4-grams of all groups up to which a model goes to the tasks; a larger one stays in tables.
SEND_BYTES = 32_000_000
WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x02" * (ORDER - 1), "\x03"
_MASKS = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]
_16 = np.uint64(16)


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all words in order, and how many each word has."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    codes = np.frombuffer("".join([f"{_START}{w}{_END}" for w in words]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    codes = (codes ^ (codes >> _16) * np.uint64(0x9E37)) & _MASKS[1]
    keys = np.zeros(max(0, len(codes) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        keys = (keys << _16) | codes[k: k + len(keys)]
    # The last three windows that begin in a word's end reach into the next word.
    block = np.repeat(np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1, sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return keys[block + inside], sizes


_COUNTS = "grp string, gram long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        groups, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        for part in pieces(texts):
            words: dict[str, Counter] = {}
            for g, t in zip(groups[at: at + len(part)], part):
                words.setdefault(g, Counter()).update(WORD.findall((t or "").lower()))
            at += len(part)
            for g, counter in words.items():
                if counter:
                    keys, sizes = gram_keys(list(counter))
                    n = np.repeat(np.fromiter(counter.values(), np.int64, len(counter)), sizes)
                    old = held.get(g, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    keys, place = np.unique(np.concatenate((old[0], keys)), return_inverse=True)
                    held[g] = keys, np.bincount(place, np.concatenate((old[1], n)), len(keys)).astype(np.int64)
        if sum(len(k) for k, _ in held.values()) > 4_000_000:
            yield from _rows(held)
            held = {}
    yield from _rows(held)


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for g, (keys, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([g] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["grp", "gram", "n"])


def _summed(texts: DataFrame) -> DataFrame:
    """``grp, gram, n``: stored counts of all 4-grams of ``texts`` (``grp, text``)."""
    counts = texts.select("grp", "text").mapInArrow(_count, _COUNTS).groupBy("grp", "gram").agg(F.sum("n").alias("n"))
    return materialize(counts, label="grams")


def _collected(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    rows = counts.select("grp", "gram", "n").toArrow()
    grp, gram, n = (rows.column(c).to_numpy() for c in range(3))
    return {g: (gram[grp == g].view(np.uint64), n[grp == g]) for g in sorted(set(grp))}


def gram_counts(texts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of all 4-grams of ``texts`` (``grp, text``) by group."""
    return _collected(_summed(texts))


def learn(texts: DataFrame) -> CharModel | StoredModel | None:
    """A model of every group of ``texts`` (``grp, text``); none without a letter.

    All 4-grams count, whatever their number; the size only decides where the model lies.
    """
    counts = _summed(texts)
    sizes = dict(counts.groupBy("grp").count().collect())
    if not sizes:
        return None
    if sum(sizes.values()) * (8 + 4 * len(sizes)) <= SEND_BYTES:
        return kneser_ney(_collected(counts))
    return kneser_ney_tables(counts, sorted(sizes))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return place, table[place] == keys


@dataclass
class CharModel:
    """Log-probabilities of kept grams and log-weights of their contexts, per order, for all groups."""

    groups: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unseen: float

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of packed 4-grams, a column per group."""
        out = np.zeros((len(keys), len(self.groups)), np.float32)
        todo = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            own = keys[todo] & _MASKS[n]
            place, there = _find(self.grams[n], mix(own))
            out[todo[there]] += self.logs[n][place[there]]
            todo, own = todo[~there], own[~there]
            if n > 1 and len(todo):
                place, there = _find(self.contexts[n], mix(own >> _16))
                out[todo[there]] += self.weights[n][place[there]]
        out[todo] += self.unseen
        return out

    def log(self, key: int) -> float:
        """``score`` of one packed 4-gram in the first group, without arrays."""
        out = np.float32(0)
        for n in range(ORDER, 0, -1):
            own = key & (1 << 16 * n) - 1
            table, name = self.grams[n], np.uint64(mix_one(own))
            place = table.searchsorted(name)
            if place < len(table) and table[place] == name:
                return float(out + self.logs[n][place, 0])
            if n > 1:
                table, name = self.contexts[n], np.uint64(mix_one(own >> 16))
                place = table.searchsorted(name)
                if place < len(table) and table[place] == name:
                    out = out + self.weights[n][place, 0]
        return float(out + np.float32(self.unseen))

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word per group, and its number of grams."""
        if not words:
            return np.zeros((0, len(self.groups)), np.float32), np.zeros(0, np.int64)
        keys, sizes = gram_keys(words)
        return np.add.reduceat(self.score(keys), np.cumsum(sizes) - sizes, axis=0), sizes


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> CharModel:
    """Models of all groups from their 4-gram counts."""
    groups = sorted(counts)
    tables = []
    for g in groups:
        order = np.argsort(counts[g][0])
        own = {ORDER: (counts[g][0][order], counts[g][1][order])}
        for n in range(ORDER - 1, 0, -1):
            longer, seen = own[n + 1]
            # A gram counts once for each letter before it; at the start of a word there is only one, so there its count stands.
            first = (longer >> np.uint64(16 * (n - 1))) & _MASKS[1]
            keys, place = np.unique(longer & _MASKS[n], return_inverse=True)
            own[n] = keys, np.bincount(place, np.where(first == 2, seen, 1), len(keys)).astype(np.int64)
        tables.append(own)
    letters = np.unique(np.concatenate([t[1][0] for t in tables])) if tables else np.zeros(0, np.uint64)
    unseen = -np.log(len(letters) + 1.0)
    empty = np.zeros(0, np.uint64)
    grams, logs, contexts, weights = ([empty] * (ORDER + 1) for _ in range(4))
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([t[n][0] for t in tables])) if tables else empty
        heads = np.unique(keys >> _16)
        probability, weight = np.zeros((len(keys), len(groups))), np.ones((len(heads), len(groups)))
        for j, t in enumerate(tables):
            own, seen = t[n]
            once, twice = (seen == 1).sum(), (seen == 2).sum()
            discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
            context, place = np.unique(own >> _16, return_inverse=True)
            total, kinds = np.bincount(place, seen), np.bincount(place)
            at, there = _find(context, heads)
            weight[there, j] = discount * kinds[at[there]] / total[at[there]]
            at, there = _find(own, keys)
            probability[there, j] = np.maximum(seen[at[there]] - discount, 0) / total[place[at[there]]]
        at = np.searchsorted(heads, keys >> _16)
        below = np.exp(unseen) if lower is None else lower[1][np.searchsorted(lower[0], keys & _MASKS[n - 1])]
        probability += weight[at] * below
        lower = keys, probability
        for store, values, names in ((logs, probability, keys), (weights, weight, heads)):
            order = np.argsort(mix(names))
            store[n] = np.log(np.maximum(values[order], 1e-30)).astype(np.float32)
            (grams if store is logs else contexts)[n] = mix(names)[order]
    return CharModel(groups, grams, logs, contexts, weights, float(unseen))


@dataclass
class StoredModel:
    """What a CharModel holds, per order in tables: ``gram, p`` and ``head, w``, arrays by group."""

    groups: list[str]
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    unseen: float

    def logs(self, keys: DataFrame) -> DataFrame:
        """``gram, logs`` for the distinct packed 4-grams ``gram`` of ``keys``."""
        out, logs = keys.select("gram").distinct(), F.array_repeat(F.lit(self.unseen), len(self.groups))
        none = F.array_repeat(F.lit(0.0), len(self.groups))
        for n in range(ORDER, 0, -1):
            out = out.withColumn("own", _low(F.col("gram"), n))
            out = out.join(self.grams[n].select(F.col("gram").alias("own"), F.transform("p", _log).alias(f"p{n}")), "own", "left")
            if n > 1:
                out = out.withColumn("own", F.shiftrightunsigned("own", 16))
                out = out.join(self.contexts[n].select(F.col("head").alias("own"), F.transform("w", _log).alias(f"w{n}")), "own", "left")
            out = out.drop("own")
        for n in range(1, ORDER + 1):
            below = logs if n == 1 else F.zip_with(F.coalesce(f"w{n}", none), logs, lambda a, b: a + b)
            logs = F.coalesce(f"p{n}", below)
        return out.select("gram", logs.alias("logs"))

    def word_scores(self, words: DataFrame) -> DataFrame:
        """``word, logs, chars``: as of a CharModel, for the distinct words ``word``."""
        grams = words.select("word").distinct().mapInArrow(_word_grams, "word string, gram long, n long")
        total = F.array(*[F.sum(F.col("n") * F.col("logs")[j]) for j in range(len(self.groups))])
        return grams.join(self.logs(grams), "gram").groupBy("word").agg(total.alias("logs"), F.sum("n").alias("chars"))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-30)))


def _low(gram: Column, n: int) -> Column:
    """The last ``n`` letters."""
    return gram if n == ORDER else gram.bitwiseAND(F.lit((1 << 16 * n) - 1))


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in pieces(batch.column(0).to_pylist()):
            keys, sizes = gram_keys(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(words, object), sizes), pa.string()), pa.array(keys.view(np.int64)), pa.array(np.ones(len(keys), np.int64))],
                ["word", "gram", "n"])


def kneser_ney_tables(counts: DataFrame, groups: list[str]) -> StoredModel:
    """``kneser_ney`` in Spark, over the counts ``grp, gram, n`` of 4-grams."""
    own = {ORDER: counts.select("grp", "gram", "n")}
    for n in range(ORDER - 1, 0, -1):
        first = F.shiftrightunsigned("gram", 16 * (n - 1)).bitwiseAND(F.lit(0xFFFF))
        seen = F.sum(F.when(first == 2, F.col("n")).otherwise(1))
        own[n] = materialize(own[n + 1].groupBy("grp", _low(F.col("gram"), n).alias("gram")).agg(seen.cast("long").alias("n")), label=f"grams-{n}")
    unseen = -float(np.log(own[1].select("gram").distinct().count() + 1.0))
    grams: dict[int, DataFrame] = {}
    contexts: dict[int, DataFrame] = {}

    def by_group(df: DataFrame, key: str, value: str, missing: float) -> DataFrame:
        return df.groupBy(key).agg(F.array(*[F.coalesce(F.max(F.when(F.col("grp") == g, F.col(value))), F.lit(missing)) for g in groups]).alias(value))

    for n in range(1, ORDER + 1):
        found = {r["grp"]: r for r in own[n].groupBy("grp").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
        amounts = {g: min(0.95, max(0.05, r["once"] / (r["once"] + 2 * r["twice"]))) if r["once"] + r["twice"] else 0.5 for g, r in found.items()}
        discount = F.create_map(*[F.lit(x) for item in amounts.items() for x in item])[F.col("grp")]
        rows = own[n].withColumn("head", F.shiftrightunsigned("gram", 16))
        heads = materialize(rows.groupBy("grp", "head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), label=f"contexts-{n}")
        contexts[n] = materialize(by_group(heads.withColumn("w", discount * F.col("kinds") / F.col("total")), "head", "w", 1.0), label=f"weights-{n}")
        p = rows.join(heads, ["grp", "head"]).withColumn("p", F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total"))
        p = by_group(p, "gram", "p", 0.0).withColumn("head", F.shiftrightunsigned("gram", 16)).join(contexts[n], "head")
        if n == 1:
            p = p.withColumn("below", F.array_repeat(F.lit(float(np.exp(unseen))), len(groups)))
        else:
            p = p.withColumn("low", _low(F.col("gram"), n - 1)).join(grams[n - 1].select(F.col("gram").alias("low"), F.col("p").alias("below")), "low")
        full = F.zip_with("p", F.zip_with("w", "below", lambda a, b: a * b), lambda a, b: a + b)
        grams[n] = materialize(p.select("gram", full.alias("p")), label=f"probabilities-{n}")
    return StoredModel(groups, grams, contexts, unseen)
