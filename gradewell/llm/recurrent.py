"""A gated recurrent language model in numpy, with a class-factored softmax over a vocabulary without bound.

Symbols are the end of a text (0), the most frequent words, and word forms: groups
that every other word belongs to by its last letters, also words never seen.  A
step reads a symbol and gives the next one's class; frequent words are then chosen
by a softmax within their class, and a form's word by its share of the corpus
counts (see ``lm_scoring``).  Probabilities of all words and the end add up to one.

Texts are laid end to end in lanes that run in step; a lane's state is carried from
window to window and cleared where a text begins, so the likelihood of a text is
that of the whole text however long it is.  Training cuts gradients at windows.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Frequent words with the end, in classes of equal size by frequency, and forms, a class each.
WORDS, PER_CLASS, FORMS = 1024, 64, 16
WORD_CLASSES = WORDS // PER_CLASS
CLASSES = WORD_CLASSES + FORMS
SYMBOLS = WORDS + FORMS
HIDDEN = 16
#: Steps between which gradients flow, steps scored at once, and most lanes.
WINDOW, BLOCK, LANES = 16, 32, 512
RATE = 0.08

# "read" has the parts of the new state, the reset and the update gate, "state" those of reset, update and new state.
_SHAPES = {
    "read": (SYMBOLS, 3 * HIDDEN),
    "state": (HIDDEN, 3 * HIDDEN),
    "class": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "word": (WORD_CLASSES, HIDDEN, PER_CLASS),
    "word_bias": (WORD_CLASSES, PER_CLASS),
}
Weights = dict[str, np.ndarray]


def initial(counts: np.ndarray) -> Weights:
    """Weights that give symbols the shares of ``counts`` in any state."""
    pick = np.random.default_rng(12)
    w = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    w["read"] += pick.normal(0, 0.3, w["read"].shape).astype(np.float32)
    w["state"] += pick.normal(0, HIDDEN**-0.5, w["state"].shape).astype(np.float32)
    own = counts.astype(np.float64) + 0.1
    words = own[:WORDS].reshape(WORD_CLASSES, PER_CLASS)
    w["word_bias"] += np.log(words).astype(np.float32)
    mass = np.concatenate((words.sum(axis=1), own[WORDS:]))
    w["class_bias"] += np.log(mass / mass.sum()).astype(np.float32)
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in _SHAPES])


def shaped(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at: at + n].reshape(s).copy()
        at += n
    return out


class Lanes:
    """Texts (arrays of symbols, each with its end) laid end to end in lanes of nearly equal length.

    Arrays by step and lane: ``read`` and ``goal`` symbols, ``text`` numbers, and
    whether a step is a text's ``first``.  Lanes are ordered by length; ``alive``
    says how many still run at a step.
    """

    def __init__(self, texts: list[np.ndarray]):
        sizes = [len(t) for t in texts]
        total = sum(sizes)
        count = int(min(LANES, max(1, total // max(max(sizes, default=1), WINDOW))))
        loads = [(0, k) for k in range(count)]
        own: list[list[int]] = [[] for _ in range(count)]
        for i in sorted(range(len(texts)), key=lambda i: -sizes[i]):
            load, k = loads[0]
            own[k].append(i)
            heapq.heapreplace(loads, (load + sizes[i], k))
        lengths = [sum(sizes[i] for i in o) for o in own]
        own = [own[k] for k in sorted(range(count), key=lambda k: -lengths[k])]
        steps = max(lengths, default=0)
        self.goal = np.zeros((steps, count), np.int32)
        self.text = np.zeros((steps, count), np.int32)
        self.first = np.zeros((steps, count), bool)
        self.lengths = np.sort(lengths)[::-1]
        for k, o in enumerate(own):
            if o:
                n = [sizes[i] for i in o]
                self.goal[: sum(n), k] = np.concatenate([texts[i] for i in o])
                self.text[: sum(n), k] = np.repeat(o, n)
                self.first[np.cumsum([0, *n[:-1]]), k] = True
        self.read = np.concatenate((np.zeros((1, count), np.int32), self.goal[:-1])) if steps else self.goal
        self.steps, self.count = steps, count

    def alive(self, step: int) -> int:
        return int(np.searchsorted(-self.lengths, -step, "left"))

    def windows(self, size: int):
        """First steps, ends and lanes of all windows.  Where a window ends, lanes may have run out: their goals there do not count."""
        for a in range(0, self.steps, size):
            yield a, min(a + size, self.steps), self.alive(a)


def _gates(x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reset and update gates side by side, and the new state they are to mix in."""
    s = _sigmoid(x[:, HIDDEN:] + g[:, : 2 * HIDDEN])
    n = s[:, :HIDDEN] * g[:, 2 * HIDDEN:]
    n += x[:, :HIDDEN]
    n *= 2
    n = _sigmoid(n)
    n *= 2
    n -= 1
    return s, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; exponentials of numbers below -80 would overflow."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _bounded(logits: np.ndarray) -> np.ndarray:
    """In place, shifted by rows where exponentials might not fit."""
    if logits.size and (logits.max() > 60 or logits.min() < -60):
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _shares(logits: np.ndarray) -> np.ndarray:
    """Softmax of rows, in place."""
    np.exp(_bounded(logits), out=logits)
    logits /= logits @ np.ones((logits.shape[1], 1), np.float32)
    return logits


def _log_share(logits: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Logarithm of one number of each row of the softmax."""
    own = _bounded(logits)[np.arange(len(logits)), goal]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


def classes(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < WORDS, symbols // PER_CLASS, symbols - WORDS + WORD_CLASSES)


def _by_class(c: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of each class of frequent words."""
    order = np.argsort(c.astype(np.int16), kind="stable")
    ends = np.searchsorted(c[order], np.arange(WORD_CLASSES + 1))
    return [(k, order[ends[k]: ends[k + 1]]) for k in range(WORD_CLASSES) if ends[k] < ends[k + 1]]


def log_probabilities(w: Weights, h: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Natural logarithms of the symbols' probabilities in states ``h``."""
    c = classes(goal)
    out = _log_share(_logits(h, w["class"], w["class_bias"]), c)
    place = goal % PER_CLASS
    for k, at in _by_class(c):
        out[at] += _log_share(_logits(h.take(at, axis=0), w["word"][k], w["word_bias"][k]), place.take(at))
    return out


def _logits(h: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = h @ w
    out += bias
    return out


def likelihoods(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text's symbols."""
    lanes, total = Lanes(texts), np.zeros(len(texts))
    h = np.zeros((lanes.count, HIDDEN), np.float32)
    for a, b, n in lanes.windows(BLOCK):
        h = h[:n]
        states = np.empty((b - a, n, HIDDEN), np.float32)
        x = w["read"].take(lanes.read[a:b, :n], axis=0)
        for t in range(b - a):
            new = lanes.first[a + t, :n]
            if new.any():
                h = np.where(new[:, None], np.float32(0), h)
            s, fresh = _gates(x[t], h @ w["state"])
            h = fresh + s[:, HIDDEN:] * (h - fresh)
            states[t] = h
        counts = (np.arange(a, b)[:, None] < lanes.lengths[None, :n]).reshape(-1)
        logs = log_probabilities(w, states.reshape(-1, HIDDEN), lanes.goal[a:b, :n].reshape(-1))
        total += np.bincount(lanes.text[a:b, :n].reshape(-1), weights=np.where(counts, logs, 0), minlength=len(texts))
    return total / np.log(10)


class Trainer:
    """Weights moved by gradients of windows, with a step size for every weight that falls with its past gradients."""

    def __init__(self, w: Weights, past: Weights | None = None):
        self.w = w
        self.past = past or {k: np.ones(s, np.float32) for k, s in _SHAPES.items()}
        self.tokens = 0

    def _move(self, name: str, grad: np.ndarray, at=...) -> None:
        self.past[name][at] += grad * grad
        self.w[name][at] -= np.float32(RATE) * grad / np.sqrt(self.past[name][at])

    def learn(self, texts: list[np.ndarray]) -> None:
        lanes = Lanes(texts)
        h = np.zeros((lanes.count, HIDDEN), np.float32)
        for a, b, n in lanes.windows(WINDOW):
            h = self._window(lanes, a, b, h[:n])
        self.tokens += sum(len(t) for t in texts)

    def _window(self, lanes: Lanes, a: int, b: int, h: np.ndarray) -> np.ndarray:
        w, n, steps = self.w, len(h), b - a
        read, goal = lanes.read[a:b, :n], lanes.goal[a:b, :n].reshape(-1)
        counts = (np.arange(a, b)[:, None] < lanes.lengths[None, :n]).reshape(-1)
        x = w["read"].take(read, axis=0)
        before, states, fresh = (np.empty((steps, n, HIDDEN), np.float32) for _ in range(3))
        gates, inner = np.empty((steps, n, 2 * HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        first = lanes.first[a:b, :n]
        for t in range(steps):
            if first[t].any():
                h = np.where(first[t][:, None], np.float32(0), h)
            g = h @ w["state"]
            before[t], inner[t] = h, g[:, 2 * HIDDEN:]
            gates[t], fresh[t] = _gates(x[t], g)
            h = fresh[t] + gates[t][:, HIDDEN:] * (h - fresh[t])
            states[t] = h
        flow = self._outputs(states.reshape(-1, HIDDEN), goal, counts).reshape(steps, n, HIDDEN)
        r, z = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        slope = gates * (1 - gates)
        to_new = (1 - z) * (1 - fresh * fresh)
        to_reset, to_update = inner * slope[:, :, :HIDDEN], (before - fresh) * slope[:, :, HIDDEN:]
        # Gradients of new state, reset and update for "read", and from the second on, with the last, for "state".
        grads = np.empty((steps, n, 4 * HIDDEN), np.float32)
        new, reset, update, last = (grads[:, :, k * HIDDEN: (k + 1) * HIDDEN] for k in range(4))
        turned = np.ascontiguousarray(w["state"].T)
        back = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            dh = flow[t]
            dh += back
            np.multiply(dh, to_new[t], out=new[t])
            np.multiply(new[t], to_reset[t], out=reset[t])
            np.multiply(dh, to_update[t], out=update[t])
            np.multiply(new[t], r[t], out=last[t])
            back = grads[t, :, HIDDEN:] @ turned
            dh *= z[t]
            back += dh
            if first[t].any():
                back[first[t]] = 0
        flat_grads = grads.reshape(-1, 4 * HIDDEN)
        self._move("state", before.reshape(-1, HIDDEN).T @ flat_grads[:, HIDDEN:])
        symbols = read.reshape(-1)
        order = np.argsort(symbols.astype(np.int16), kind="stable")
        own = symbols[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        self._move("read", np.add.reduceat(flat_grads[:, : 3 * HIDDEN].take(order, axis=0), starts, axis=0), own[starts])
        return h

    def _outputs(self, h: np.ndarray, goal: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Moves the output weights; returns the gradients of the states."""
        w, c = self.w, classes(goal)
        p = _shares(_logits(h, w["class"], w["class_bias"]))
        p[np.arange(len(h)), c] -= 1
        if not counts.all():
            p[~counts] = 0
            c = np.where(counts, c, CLASSES)
        flow = p @ w["class"].T
        self._move("class", h.T @ p)
        self._move("class_bias", np.ones(len(p), np.float32) @ p)
        place = goal % PER_CLASS
        for k, at in _by_class(c):
            own = h.take(at, axis=0)
            q = _shares(_logits(own, w["word"][k], w["word_bias"][k]))
            q[np.arange(len(at)), place.take(at)] -= 1
            flow[at] += q @ w["word"][k].T
            self._move("word", own.T @ q, k)
            self._move("word_bias", np.ones(len(at), np.float32) @ q, k)
        return flow
