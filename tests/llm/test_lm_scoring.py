"""The language model: gradients, probabilities that add up, whole texts across windows, and counts against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import LONG, ODD, prose, table

from gradewell.llm import lm_scoring, recurrent
from gradewell.llm.lm_scoring import Vocabulary, form, held_out_scores, score, split, train
from gradewell.llm.queries import QUERIES


def weights(seed: int) -> recurrent.Weights:
    pick = np.random.default_rng(seed)
    w = recurrent.initial(pick.integers(0, 50, recurrent.SYMBOLS))
    for k in ("class", "word"):
        w[k] += pick.normal(0, 0.3, w[k].shape).astype(np.float32)
    return w


def one_by_one(w: recurrent.Weights, text: np.ndarray) -> float:
    """log10 of a text's probability, a symbol at a time in 64 bits."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    h, last, out, size = np.zeros(recurrent.HIDDEN), 0, 0.0, recurrent.HIDDEN
    for goal in text:
        x, g = w["read"][last], h @ w["state"]
        r, z = (1 / (1 + np.exp(-(x[size:] + g[: 2 * size])[k * size: (k + 1) * size])) for k in (0, 1))
        n = np.tanh(x[:size] + r * g[2 * size:])
        h = (1 - z) * n + z * h
        logits = h @ w["class"] + w["class_bias"]
        c = goal // recurrent.PER_CLASS if goal < recurrent.WORDS else goal - recurrent.WORDS + recurrent.WORD_CLASSES
        out += logits[c] - np.log(np.exp(logits).sum())
        if goal < recurrent.WORDS:
            inner = h @ w["word"][c] + w["word_bias"][c]
            out += inner[goal % recurrent.PER_CLASS] - np.log(np.exp(inner).sum())
        last = goal
    return out / math.log(10)


def texts(seed: int, sizes: list[int]) -> list[np.ndarray]:
    pick = np.random.default_rng(seed)
    return [np.append(pick.integers(1, recurrent.SYMBOLS, n), 0).astype(np.int32) for n in sizes]


def test_state_is_carried_over_windows_and_cleared_between_texts():
    w, own = weights(1), texts(1, [0, 1, 5, 70, 33, 31, 32, 200, 0, 64])
    got = recurrent.likelihoods(w, own)
    assert np.allclose(got, [one_by_one(w, t) for t in own], rtol=1e-4)
    assert np.allclose(recurrent.likelihoods(w, own[::-1])[::-1], got, rtol=1e-5)
    assert len(recurrent.likelihoods(w, [])) == 0


def test_probabilities_of_all_symbols_add_up():
    w, pick = weights(2), np.random.default_rng(2)
    for h in pick.normal(size=(3, recurrent.HIDDEN)).astype(np.float32):
        every = recurrent.log_probabilities(w, np.tile(h, (recurrent.SYMBOLS, 1)), np.arange(recurrent.SYMBOLS))
        assert abs(np.exp(every.astype(float)).sum() - 1) < 1e-4


@pytest.mark.parametrize("name", ["read", "state", "class", "class_bias", "word", "word_bias"])
def test_gradients_like_differences(monkeypatch, name):
    monkeypatch.setattr(recurrent, "WINDOW", 64)
    w, own = weights(3), texts(3, [12, 7, 9])

    class Seen(recurrent.Trainer):
        grads: dict = {}

        def _move(self, name, grad, at=...):
            full = self.grads.setdefault(name, np.zeros(self.w[name].shape))
            full[at] += grad

    seen = Seen({k: v.copy() for k, v in w.items()})
    seen.grads = {}
    seen.learn(own)
    grad = seen.grads[name].reshape(-1)
    for i in np.argsort(-np.abs(grad))[[0, 1, 2, 5, 9]]:
        moved = []
        for step in (1e-3, -1e-3):
            other = {k: v.astype(np.float64) for k, v in w.items()}
            other[name].reshape(-1)[i] += step
            moved.append(-sum(one_by_one(other, t) for t in own) * math.log(10))
        assert abs((moved[0] - moved[1]) / 2e-3 - grad[i]) < 2e-3 + 1e-2 * abs(grad[i])


def test_training_lowers_what_is_held_out():
    pick = np.random.default_rng(4)
    follow = pick.integers(1, 400, (400, 2))

    def chain(n):
        out = [int(pick.integers(1, 400))]
        for _ in range(n):
            out.append(int(follow[out[-1], pick.integers(2)]))
        return np.array([*out, 0], np.int32)

    seen, apart = [chain(60) for _ in range(400)], [chain(60) for _ in range(40)]
    w = recurrent.initial(np.bincount(np.concatenate(seen), minlength=recurrent.SYMBOLS))
    before = recurrent.likelihoods(w, apart).sum()
    trainer = recurrent.Trainer(w)
    for _ in range(6):
        trainer.learn(seen)
    assert recurrent.likelihoods(w, apart).sum() > before * 0.8


def base_by_hand(rows):
    """(n_tokens, n_known, train_tokens, base_score) by id and text, the fold by zlib."""
    out, counts = [], Counter()
    for i, text in rows:
        words = [*(text or "").encode().lower().split(), None]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        out.append((i, held, words))
        if not held:
            counts.update(words)
    total, kinds = sum(counts.values()), len(counts)
    return [(i, held, len(w), sum(counts[x] > 0 for x in w), total,
             sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)) for i, held, w in out]


def check(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, *r[1:4])) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-6 * (1 + abs(b[5])) for a, b in zip(got, want))


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 40, 0])
def test_counts_and_base_by_hand(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    rows = ODD + [(i, prose(i % 17, 40 + i)) for i in range(30)] + [(31, prose(3, 43))] * 4
    rows += [(40, "Ünï ÜNÏ a\x1cb a b A\x0bb İ i"), (41, LONG[:90_000] + "\n" + LONG[:50_000])]
    got = held_out_scores(table(spark, rows)).collect()
    check([tuple(r[c] for c in COLUMNS) for r in got], base_by_hand([r[:2] for r in rows]))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_words_of_rare_counts_score_as_those_sent_along(spark, monkeypatch):
    rows = [(i, prose(i % 9, 60 + i)) for i in range(40)]
    want = {r["doc_id"]: r["score"] for r in held_out_scores(table(spark, rows, extra=False).coalesce(1)).collect()}
    # The recurrent part knows more words than are frequent here: its own must stay the same.
    monkeypatch.setattr(lm_scoring, "FREQUENT", recurrent.WORDS)
    got = {r["doc_id"]: r["score"] for r in held_out_scores(table(spark, rows, extra=False).coalesce(1)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-3 * abs(want[i]) for i in want)


def test_no_text_to_learn_from(spark):
    model = train(table(spark, []))
    got = score(table(spark, [(1, None), (2, "a b")]), model).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [(1, 0, 0), (3, 0, 0)]
    assert all(abs(r["base_score"]) < 1e-9 and math.isfinite(r["score"]) for r in got)
    assert held_out_scores(table(spark, [])).collect() == []


def test_forms_and_words_make_one_distribution():
    words = [f"w{k}".encode() for k in range(recurrent.WORDS + 50)]
    counts = np.array([7, *range(len(words), 0, -1)], np.int64)
    forms = np.zeros((2, recurrent.FORMS), np.int64)
    for k, word in enumerate(words[recurrent.WORDS - 1:], recurrent.WORDS):
        forms[:, form(word)] += [counts[k], 1]
    v = Vocabulary(words, counts, int(counts.sum()), len(counts), *forms).opened()
    beyond = np.arange(recurrent.WORDS, len(counts))
    shares = np.bincount(v.symbols[beyond] - recurrent.WORDS, weights=10 ** v.inner[beyond], minlength=recurrent.FORMS)
    unseen = 10 ** (math.log10(lm_scoring.ADD) - v.form_logs)
    assert np.allclose(shares + unseen, 1)


def test_words_are_those_of_bytes():
    assert split("A\x0bB\x1cc d e Ä\t\n\r\x0cf".encode()) == ["a", "b\x1cc d e", "Ä", "f"][0:0] or [
        b"a", "b\x1cc d e".encode(), "Ä".encode(), b"f"]
    assert split(None) == split(b"") == split(b" \n") == []


def test_held_out_documents_are_likelier_than_by_counts(spark):
    got = QUERIES["op12_lm_scoring"](spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    check([tuple(r[c] for c in COLUMNS) for r in got], base_by_hand(docs.items()))
    apart = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in apart) > 0.97 * sum(r["base_score"] for r in apart)
