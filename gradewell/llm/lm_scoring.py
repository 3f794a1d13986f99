"""How probable texts are under a recurrent language model trained on the corpus.

Words of all training texts are counted, whatever their number; the counts give the
base score and, within word forms, the model's words.  The recurrent part
(``recurrent``) is trained in ROUNDS: in each, every task goes once over its share
of that round's documents, from the same weights, and the weights of all tasks are
averaged by tokens, in levels.  After the last round every training document has
been learned from once.

Texts are turned into symbols once and stored for all rounds and the scores.  Only
the FREQUENT words go to the tasks as a table; counts of all others are joined, a
row for each such word and document, so no count is ever cut off.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm import recurrent
from gradewell.llm.common import stored_with
from gradewell.llm.language_id import fold
from gradewell.llm.vectors import combined
from gradewell.session import materialize

#: Words whose counts go to the tasks.
FREQUENT = 131_072
ROUNDS = 4
#: What a word that was not counted is taken to have been seen.
ADD = 0.1
#: The end of a text among the counted words, none of which has white space.
END = b"\n"
#: Tokens of texts laid in lanes at once, and most tokens in a row from the same state in training.
_TOKENS, _STRETCH = 4_000_000, 2048
_DISTINCT = 400_000
#: Bytes of text turned into symbols at once.
_BYTES = 8_000_000


def split(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case: what bytes do by themselves."""
    return text.lower().split() if text else []


def form(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % recurrent.FORMS


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def full() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(split(text.as_py()))
            counts[END] += 1
            if len(counts) > _DISTINCT:
                yield full()
    if counts:
        yield full()


@dataclass
class Vocabulary:
    """The FREQUENT words by falling count, after the end, as numbers; totals of all words and of each form's."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    form_tokens: np.ndarray
    form_distinct: np.ndarray

    def opened(self) -> Vocabulary:
        """With tables for a task."""
        self.number = Numbers(zip(self.words, range(1, len(self.words) + 1)))
        self.number[END] = 0
        n = len(self.counts)
        self.symbols = np.arange(n, dtype=np.int32)
        beyond = np.arange(min(recurrent.WORDS, n), n)
        forms = np.array([form(self.words[k - 1]) for k in beyond], np.int32)
        self.symbols[beyond] = recurrent.WORDS + forms
        self.seen = np.log10(self.counts + ADD)
        # What the model takes from counts: nothing for its own words, the share in its form for others.
        self.inner = np.zeros(n)
        self.form_logs = np.log10(self.form_tokens + ADD * (self.form_distinct + 1))
        self.inner[beyond] = self.seen[beyond] - self.form_logs[forms]
        return self


class Numbers(dict):
    """Numbers of frequent words; of any other word, its form as a number below 0."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-2:]) % recurrent.FORMS


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    #: Stored counts of all words, the end included: ``word, n``.
    counts: DataFrame


def _bytes() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")


def count_words(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    counts = docs.select(_bytes()).mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts, seen = stored_with(counts, "word-counts", tokens=F.sum("n"), distinct=F.count(F.lit(1)))
    end = F.col("word") == F.lit(END)
    # Counts in steps of about four percent: whole steps from the top, and of the next one as many as fit, by hash.
    step = F.floor(F.log2("n") * 16)
    sizes = counts.where(~end).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    lowest, room = 0, FREQUENT
    for r in sizes:
        lowest = r["step"]
        if r["n"] > room:
            break
        room -= r["n"]
    size = max([r["n"] for r in sizes if r["step"] == lowest], default=1)
    share = min(1.0, room / size) if sizes and sum(r["n"] for r in sizes) > FREQUENT else 1.0
    some = F.pmod(F.xxhash64("word"), F.lit(2**30)) < int(share * 2**30)
    top = counts.where(~end & ((step > lowest) | ((step == lowest) & some))).collect()
    top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    ends = sum(r["n"] for r in counts.where(end).collect())
    words = [bytes(r["word"]) for r in top]
    number = F.pmod(F.crc32(F.when(F.octet_length("word") > 2, F.substring("word", -2, 2)).otherwise(F.col("word"))), F.lit(recurrent.FORMS))
    form_tokens, form_distinct = np.zeros((2, recurrent.FORMS), np.int64)
    for r in counts.where(~end).groupBy(number.alias("form")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect():
        form_tokens[r["form"]], form_distinct[r["form"]] = r["n"], r["d"]
    for r, word in zip(top[: recurrent.WORDS - 1], words):
        form_tokens[form(word)] -= r["n"]
        form_distinct[form(word)] -= 1
    own = np.array([ends, *[r["n"] for r in top]], np.int64)
    return counts, Vocabulary(words, own, seen["tokens"] or 0, seen["distinct"] or 0, form_tokens, form_distinct)


_ENCODED = "doc_id long, symbols binary, n_tokens long, n_known long, base double, inner double, n_rare long, rare array<struct<word: binary, n: long>>"


def _rare(found: list[list[bytes]]) -> pa.Array:
    """Each text's rare words with their numbers in it."""
    counts = [Counter(words) for words in found]
    words = pa.array([w for c in counts for w in c], pa.binary())
    n = pa.array([k for c in counts for k in c.values()], pa.int64())
    ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, n], ["word", "n"]))


def _unpacked(symbols: bytes) -> np.ndarray:
    return np.frombuffer(symbols, "<u2").astype(np.int32)


def _encode(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.opened()

        def encoded(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            words, sizes = [], []
            for text in texts:
                own = text.lower().split()
                sizes.append(len(own) + 1)
                words += own
                words.append(END)
            numbers = np.fromiter(map(tables.number.__getitem__, words), np.int32, len(words))
            starts = np.cumsum([0, *sizes[:-1]])
            far = numbers < 0
            known_as = np.maximum(numbers, 0)
            symbols, base, inner = (table[known_as] for table in (tables.symbols, tables.seen, tables.inner))
            forms = -1 - numbers[far]
            symbols[far], base[far], inner[far] = recurrent.WORDS + forms, 0, -tables.form_logs[forms]
            n_rare = np.add.reduceat(far, starts, dtype=np.int64)
            known = np.array(sizes) - n_rare - (tables.counts[0] == 0)
            packed = symbols.astype("<u2").tobytes()
            texts_of = np.split(np.flatnonzero(far), np.cumsum(n_rare)[:-1])
            ends = np.cumsum(sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([packed[2 * a: 2 * b] for a, b in zip(starts, ends)], pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(known), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(inner, starts)), pa.array(n_rare),
                 _rare([[words[k] for k in own.tolist()] for own in texts_of])],
                ["doc_id", "symbols", "n_tokens", "n_known", "base", "inner", "n_rare", "rare"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= _BYTES:
                    yield encoded(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield encoded(ids, texts)
    return run


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Stored symbols of every text, what the tables say of its words, its rare words, and a number of the row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes())
    return materialize(texts.mapInArrow(_encode(vocabulary), _ENCODED).withColumn("row", F.monotonically_increasing_id()), label="encoded-texts")


def _learn(state: np.ndarray):
    """One pass over a task's texts; its weights, their past gradients and its tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer = recurrent.Trainer(*[recurrent.shaped(half) for half in np.split(state, 2)])
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                symbols = _unpacked(text.as_py())
                held += [symbols[a: a + _STRETCH] for a in range(0, len(symbols), _STRETCH)]
                size += len(symbols)
                if size >= _TOKENS:
                    trainer.learn(held)
                    held, size = [], 0
        if held:
            trainer.learn(held)
        if trainer.tokens:
            values = np.concatenate((recurrent.flat(trainer.w), recurrent.flat(trainer.past)))
            payload = pickle.dumps((trainer.tokens, values))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([payload], pa.binary())], ["part", "payload"])
    return run


def _average(payloads: list[bytes]) -> bytes:
    found = [pickle.loads(p) for p in payloads]
    tokens = sum(n for n, _ in found)
    return pickle.dumps((tokens, sum(v * np.float32(n / tokens) for n, v in found)))


def learn(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights of the recurrent part, from every row of an encoded table once."""
    symbols = np.zeros(recurrent.SYMBOLS, np.int64)
    own = vocabulary.counts[: recurrent.WORDS]
    symbols[: len(own)] = own
    symbols[recurrent.WORDS:] = vocabulary.form_tokens
    state = recurrent.flat(recurrent.initial(symbols))
    state = np.concatenate((state, np.ones_like(state)))
    for k in range(ROUNDS):
        texts = encoded.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k).select("symbols")
        found = combined(texts.mapInArrow(_learn(state), "part long, payload binary"), _average)
        if found is not None:
            state = pickle.loads(found)[1]
    return np.split(state, 2)[0]


def train(docs: DataFrame) -> Model:
    """A model of the texts of ``docs``; a null text is empty, other columns are not read.

    Every text is counted and learned from once.  No rows: a model in which all is unseen.
    """
    counts, vocabulary = count_words(docs)
    return Model(vocabulary, learn(encode(docs.select(F.lit(None).alias("doc_id"), "text"), vocabulary), vocabulary), counts)


def _likelihoods(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = recurrent.shaped(weights)

        def scored() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(recurrent.likelihoods(w, texts))], ["row", "model"])

        rows, texts, size = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append(row)
                texts.append(_unpacked(text.as_py()))
                size += len(texts[-1])
                if size >= _TOKENS:
                    yield scored()
                    rows, texts, size = [], [], 0
        if rows:
            yield scored()
    return run


def score_encoded(encoded: DataFrame, model: Model) -> DataFrame:
    """Scores of an encoded table, as ``score``."""
    vocabulary = model.vocabulary
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    rare = rare.join(model.counts, "word").groupBy("row").agg(
        F.sum("times").alias("counted"), F.sum(F.col("times") * F.log10(F.col("n") + ADD)).alias("logs"))
    model_part = encoded.select("row", "symbols").mapInArrow(_likelihoods(model.weights), "row long, model double")
    out = encoded.drop("symbols", "rare").join(model_part, "row").join(rare, "row", "left")
    counted = F.coalesce("counted", F.lit(0).cast("long"))
    logs = F.coalesce("logs", F.lit(0.0)) + (F.col("n_rare") - counted) * float(np.log10(ADD))
    total = float(np.log10(vocabulary.tokens + ADD * (vocabulary.distinct + 1)))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + counted).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * total).alias("base_score"), (F.col("inner") + F.col("model") + logs).alias("score"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Tokens are the words and one end; ``n_known`` of them occur in the training
    texts, which have ``train_tokens``.  ``base_score`` sums up log10 of the words'
    smoothed shares, ``score`` is log10 of the probability the model gives the whole
    text.  A null text is empty and has its end only.  Rows without an id and rows
    that repeat one are scored like all others; other columns are not read.
    """
    return score_encoded(encode(docs, model.vocabulary), model)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learned from those outside fold 0 of 10."""
    held_out = fold("doc_id", 10) == 0
    counts, vocabulary = count_words(docs.where(~held_out))
    encoded = encode(docs, vocabulary)
    model = Model(vocabulary, learn(encoded.where(~held_out), vocabulary), counts)
    return score_encoded(encoded, model).withColumn("held_out", held_out)
