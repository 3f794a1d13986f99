"""Toxicity of restored text: a noisy channel decoded by Viterbi, then a linear model.

A disguised token is a lattice: digits and signs stand for letters or for nothing,
a letter said twice or more for one or two, separators for nothing or the end of a
word, a row of single letters for one or more words.  The decoder finds the path with the best sum of channel and character
language model (Kneser-Ney 4-grams over all documents).  A logistic model over
words and their fronts then scores the restored text; it is fitted on a bounded
sample of labelled documents.  A token without a sign beside a letter, a letter
said twice or a separator between letters is not decoded and stays as it is.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.charlm import WORD, CharModel, StoredModel, kneser_ney, learn
from gradewell.llm.hashing import pieces
from gradewell.llm.language_id import fold
from gradewell.llm.workers import kept
from gradewell.session import materialize

# Letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Log-costs of the channel: a sign for a letter, a sign dropped, a separator or closing sign dropped, a letter
#: repeated three times or more, a letter doubled, a word ended at a separator.
SIGN, DROPPED, SEPARATOR, REPEATED, DOUBLED, BREAK = -1.5, -4.0, -0.5, -0.7, -3.0, -0.5
#: A row of so many single letters is read as words.
SPACED = 3
#: The sample that the classifier is fitted on, and its size.
TOXIC_ROWS, CLEAN_ROWS, FEATURES = 2500, 5000, 3000
LEAST_SCORE = 0.7
#: Units that a worker keeps the weights of.
KNOWN_UNITS = 600_000

_signs = re.escape("".join(LEET))
_LETTER = r"[^\W\d_]"
_BETWEEN = r"[.\-_*]"
SUSPECT = re.compile(rf"{_LETTER}{_BETWEEN}*[{_signs}]|[{_signs}]{_BETWEEN}*{_LETTER}|({_LETTER})\1|{_LETTER}{_BETWEEN}+{_LETTER}")
_EDGE = ".,;:!?'\"()[]{}#%&*|<>-_=~+$"
#: Signs at the edge of a token that stand for no letter.
_PLAIN_EDGE = "".join(c for c in _EDGE if c not in LEET)
_NEW_WORD = 0x000200020002


class Decoder:
    """The most likely letters behind a disguised token."""

    def __init__(self, model: CharModel):
        self.model, self.known, self.done = model, {}, {}

    def _log(self, state: int, letter: int) -> float:
        key = state << 16 | letter
        if key not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = self.model.log(key)
        return self.known[key]

    def decode(self, token: str, breaks: bool = False) -> str:
        """The letters of a token; with ``breaks`` its separators may end a word, and spaces part single letters."""
        if (token, breaks) in self.done:
            return self.done[token, breaks]
        # Per state (the last three letters): log-probability and text so far.
        paths = {_NEW_WORD: (0.0, "")}
        i, closing = 0, len(token.rstrip(_EDGE))
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            if c.isalpha():
                options = [(c, 0.0)] if j - i == 1 else [(c * 2, 0.0), (c, DOUBLED)] if j - i == 2 else [(c, REPEATED), (c * 2, REPEATED)]
            elif c in LEET:
                options = [(x * n, SIGN) for x in LEET[c] for n in range(1, min(j - i, 2) + 1)] + [("", SEPARATOR if i >= closing else DROPPED)]
            else:
                options = [("", 0.0 if c == " " else SEPARATOR)] + [(" ", BREAK)] * breaks
            i = j
            after: dict[int, tuple[float, str]] = {}
            for state, (p, text) in paths.items():
                for letters, cost in options:
                    now, q = state, p + cost
                    if letters == " ":
                        if now == _NEW_WORD:
                            continue
                        now, q = _NEW_WORD, q + self._log(now, 3)
                    else:
                        for x in letters:
                            code = ord(x) if ord(x) < 65536 else (ord(x) ^ (ord(x) >> 16) * 0x9E37) & 0xFFFF
                            q += self._log(now, code)
                            now = (now << 16 | code) & 0xFFFFFFFFFFFF
                    if now not in after or q > after[now][0]:
                        after[now] = q, text + letters
            paths = after
        # A path that has just ended a word needs no other end.
        best = max(((p + (0.0 if t.endswith(" ") else self._log(s, 3)), t) for s, (p, t) in paths.items()), default=(0.0, ""))[1]
        if len(self.done) > 100_000:
            self.done.clear()
        self.done[token, breaks] = best
        return best

    def words(self, token: str) -> list[str]:
        """The words of one lower-case token or row of spaced letters, restored."""
        if " " in token:
            return self.decode(token, True).split()
        if not SUSPECT.search(token):
            return WORD.findall(token)
        core = token.strip(_PLAIN_EDGE)
        return self.decode(core, True).split() if SUSPECT.search(core) else WORD.findall(core)


def units(texts: list[str | None], index: dict[str, int] | None = None) -> tuple[list[str], list[np.ndarray]]:
    """Distinct tokens and rows of spaced letters of texts, and per text the places of its own; an ``index`` goes on being filled."""
    index = {} if index is None else index
    before = len(index)
    place = index.setdefault
    places = []
    for t in texts:
        tokens = (t or "").lower().split()
        own = np.fromiter([place(x, len(index)) for x in tokens], np.int64, len(tokens))
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        rows: list[int] = []
        if single.sum() >= SPACED:
            short = np.flatnonzero(single)
            single[short] = [tokens[k].isalpha() or tokens[k] in LEET for k in short]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], single, [False]))))
            for a, b in edges.reshape(-1, 2):
                if b - a >= SPACED and any(x.isalpha() for x in tokens[a:b]):
                    rows.append(place(" ".join(tokens[a:b]), len(index)))
                else:
                    single[a:b] = False
            own = np.concatenate((own[~single], np.array(rows, np.int64)))
        places.append(own)
    return list(islice(index, before, None)), places


def restore(text: str, model: CharModel) -> str:
    """The words of a text as the decoder reads them."""
    decoder = Decoder(model)
    found, places = units([text])
    return " ".join([w for p in places[0] for w in decoder.words(found[p])])


def features(word: str) -> list[int]:
    """Hashes of a word and its fronts."""
    return [zlib.crc32(f"={word}".encode()), *[zlib.crc32(word[:k].encode()) for k in (3, 4, 5, 6) if len(word) >= k]]


@dataclass
class ToxicityModel:
    letters: CharModel | StoredModel
    weights: dict[int, float]
    bias: float


def _sample(texts: list[list[tuple[list[str], int]]]) -> list[pa.Array]:
    """Size, hashes of features and their counts, of texts given as words and how often they come."""
    hashes, counts, sizes = [], [], []
    for text in texts:
        words: Counter = Counter()
        for ws, n in text:
            for w in ws:
                words[w] += int(n)
        found: Counter = Counter()
        for w, n in words.items():
            for h in features(w):
                found[h] += n
        hashes.append(np.fromiter(found, "<u4", len(found)).tobytes())
        counts.append(np.fromiter(found.values(), "<u4", len(found)).tobytes())
        sizes.append(sum(words.values()))
    return [pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())]


_SAMPLES = "toxic int, n long, hashes binary, counts binary"


def _samples(letters: CharModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(letters)
        for batch in batches:
            toxic, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for part in pieces(texts):
                names, places = units(part)
                found = [[(decoder.words(names[p]), n) for p, n in zip(*np.unique(own, return_counts=True))] for own in places]
                yield pa.RecordBatch.from_arrays([toxic.slice(at, len(part)), *_sample(found)], ["toxic", "n", "hashes", "counts"])
                at += len(part)
    return run


def _stored_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[(x["words"], x["n"]) for x in text or []] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *_sample(found)], ["toxic", "n", "hashes", "counts"])


def _row_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, at = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
        for part in pieces(texts):
            names, places = units(part)
            own = [np.unique(p, return_counts=True) for p in places]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(rows[at: at + len(part)], [len(p) for p, _ in own])), pa.array([names[i] for p, _ in own for i in p], pa.string()),
                pa.array([int(n) for _, c in own for n in c], pa.int64())], ["row", "unit", "n"])
            at += len(part)


class _Asked:
    """Stands for a model: notes the 4-grams that a lattice asks for; they do not depend on the answers."""

    def __init__(self):
        self.keys: set[int] = set()

    def log(self, key: int) -> float:
        self.keys.add(key)
        return 0.0


class _Given(dict):
    """Stands for a model: log-probabilities by 4-gram."""

    def log(self, key: int) -> float:
        return self[key]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for unit in batch.column(0).to_pylist():
            asked = _Asked()
            Decoder(asked).words(unit)
            keys = np.fromiter(asked.keys, np.uint64, len(asked.keys)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([unit] * len(keys), pa.string()), pa.array(keys)], ["unit", "gram"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        words = [Decoder(_Given({x["gram"] & 0xFFFFFFFFFFFFFFFF: x["log"] for x in known or []})).words(u) for u, known in zip(names, batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["unit", "words"])


def stored_units(rows: DataFrame, letters: StoredModel) -> tuple[DataFrame, DataFrame]:
    """``row, unit, n`` of the texts of ``rows`` (``row, text``), and ``unit, words`` by joins of the grams of all lattices."""
    own = materialize(rows.select("row", "text").mapInArrow(_row_units, "row long, unit string, n long"), label="text-units")
    names = materialize(own.select("unit").distinct(), label="distinct-units")
    asked = materialize(names.mapInArrow(_asked, "unit string, gram long"), label="lattice-grams")
    known = asked.join(letters.logs(asked), "gram").groupBy("unit").agg(F.collect_list(F.struct("gram", F.col("logs")[0].alias("log"))).alias("known"))
    return own, materialize(names.join(known, "unit", "left").mapInArrow(_decoded, "unit string, words array<string>"), label="decoded-units")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents, how many of each class hold each feature."""
    for batch in batches:
        hashes = batch.column(2).to_pylist()
        names, column = np.unique(np.frombuffer(b"".join(hashes), "<u4"), return_inverse=True)
        toxic = np.repeat(batch.column(0).to_numpy(), [len(h) // 4 for h in hashes])
        n = np.bincount(column, minlength=len(names))
        with_ = np.bincount(column, toxic, len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(with_), pa.array(n)], ["feature", "toxic", "n"])


def _of_features(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for h, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                h, c = np.frombuffer(h, "<u4"), np.frombuffer(c, "<u4")
                held = np.isin(h, features)
                names.append(h[held].tobytes())
                counts.append(c[held].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(counts, pa.binary())], batch.schema.names)
    return run


def chosen_features(samples: DataFrame) -> tuple[DataFrame, np.ndarray, int, int]:
    """The samples with the FEATURES hashes only that tell the classes apart best, these hashes in order, and toxic and clean documents."""
    n1, n0 = samples.select(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    held = samples.mapInArrow(_occurrences, "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    p = (F.col("n") + 1) / (n1 + n0 + 2)
    apart = ((F.col("toxic") + 0.5) / (n1 + 1) - (F.col("n") - F.col("toxic") + 0.5) / (n0 + 1)) / F.sqrt(p * (1 - p))
    best = held.where("n >= 4").orderBy(F.desc(F.abs(apart)), "feature").limit(FEATURES).select("feature").collect()
    features = np.array(sorted(r["feature"] for r in best), "<u4")
    return samples.mapInArrow(_of_features(features), _SAMPLES), features, n1, n0


def _fit(features: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, hashes: list[bytes], counts: list[bytes]) -> tuple[dict[int, float], float]:
    """Weights of the features, by logistic regression with equal classes."""
    row = np.repeat(np.arange(len(toxic)), [len(h) // 4 for h in hashes])
    column = np.searchsorted(features, np.frombuffer(b"".join(hashes), "<u4"))
    value = np.frombuffer(b"".join(counts), "<u4") * 50.0 / np.maximum(sizes, 1)[row]
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    w, b = np.zeros(len(features)), 0.0
    steps, step = np.full(len(features), 1e-8), 1e-8
    weight = np.where(toxic == 1, 0.5 / n1, 0.5 / n0)
    for _ in range(200):
        z = np.bincount(row, value * w[column], len(toxic)) + b
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) * weight
        g = np.bincount(column, value * off[row], len(features)) + 5e-4 * w
        steps += g * g
        step += off.sum() ** 2
        w -= 0.5 * g / np.sqrt(steps)
        b -= 0.5 * off.sum() / np.sqrt(step)
    return dict(zip(features.tolist(), w.tolist())), float(b)


def train(docs: DataFrame, labelled: DataFrame) -> ToxicityModel:
    """The language model from all of ``docs`` (``text``), the classifier from a sample of ``labelled`` (``doc_id, toxic``).

    At most TOXIC_ROWS and CLEAN_ROWS documents are taken, the ones with the
    smallest hashes of their id; the id is no feature.  Without both kinds of
    labels every score is one half.
    """
    letters = learn(docs.select(F.lit("").alias("grp"), F.col("text").cast("string").alias("text")).where("text is not null"))
    if letters is None:
        letters = kneser_ney({"": (np.array([0x0002000200020003], np.uint64), np.array([1]))})
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    order = F.xxhash64("doc_id")
    sample = rows.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS).unionByName(
        rows.where("toxic = 0").orderBy(order, "doc_id").limit(CLEAN_ROWS))
    sample = materialize(sample, label="labelled-sample")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("toxic", "text")
    if isinstance(letters, StoredModel):
        texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), label="sample-texts")
        own, words = stored_units(texts, letters)
        own = own.join(words, "unit").groupBy("row").agg(F.collect_list(F.struct("words", "n")).alias("words"))
        samples = texts.select("row", "toxic").join(own, "row", "left").select("toxic", "words").mapInArrow(_stored_samples, _SAMPLES)
    else:
        samples = texts.mapInArrow(_samples(letters), _SAMPLES)
    samples, features, n1, n0 = chosen_features(materialize(samples, label="samples"))
    if not n1 or not n0:
        return ToxicityModel(letters, {}, 0.0)
    # At most FEATURES numbers of each sampled document, however long it is.
    found = samples.toArrow()
    toxic = found.column(0).to_numpy().astype(float)
    weights, bias = _fit(features, toxic, found.column(1).to_numpy(), found.column(2).to_pylist(), found.column(3).to_pylist())
    return ToxicityModel(letters, weights, bias)


class _Read:
    """Numbers of words and weights of the units that a worker has met under one model."""

    def __init__(self, model: ToxicityModel):
        self.decoder, self.weights = Decoder(model.letters), model.weights
        self.index: dict[str, int] = {}
        self.size, self.weight = np.zeros(0), np.zeros(0)

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > KNOWN_UNITS:
            self.__init__(ToxicityModel(self.decoder.model, self.weights, 0.0))
        names, places = units(texts, self.index)
        get, words = self.weights.get, [self.decoder.words(u) for u in names]
        self.size = np.append(self.size, np.array([len(ws) for ws in words], float))
        self.weight = np.append(self.weight, np.array([sum(get(h, 0.0) for w in ws for h in features(w)) for ws in words], float))
        return places


def _worker_read(key: str, model: ToxicityModel) -> _Read:
    """What this worker has read under the model of that key; one model at a time."""
    reads = kept("toxicity")
    if key not in reads:
        reads.clear()
        reads[key] = _Read(model)
    return reads[key]


def _scores(model: ToxicityModel):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _worker_read(key, model)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for part in pieces(texts):
                places = read.places(part)
                z = [read.weight[own].sum() * 50.0 / max(read.size[own].sum(), 1.0) for own in places]
                score = 1 / (1 + np.exp(-np.clip(np.array(z) + model.bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(score)], ["doc_id", "score"])
                at += len(part)
    return run


def _unit_weights(weights: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).to_pylist()
            weight = [sum(weights.get(h, 0.0) for w in ws for h in features(w)) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array(weight, pa.float64())],
                                             ["unit", "size", "weight"])
    return run


def _stored_scores(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), label="numbered-texts")
    own, words = stored_units(rows, model.letters)
    each = own.join(words.mapInArrow(_unit_weights(model.weights), "unit string, size long, weight double"), "unit")
    total = F.sum(F.col("n") * F.col("weight")) * 50.0 / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))
    z = F.coalesce("z", F.lit(0.0)) + F.lit(model.bias)
    out = rows.select("row", "doc_id").join(each.groupBy("row").agg(total.alias("z")), "row", "left")
    return out.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))).alias("score"))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    ``predicted`` is 1 from a score of LEAST_SCORE on.  Null and empty texts have
    the score of no words.  Rows without an id and repeated rows are rows like
    others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = isinstance(model.letters, StoredModel)
    out = _stored_scores(rows, model) if stored else rows.mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, with labels learned from those outside fold 1 of 3 only."""
    model = train(docs, labels.where(fold("doc_id", 3) != 1))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
