"""Word and shingle hashes of many texts at once, for use inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  A hash is 64 bits; sets
of shingles are sets of these hashes.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
_STEP = 4096
_POWERS = np.full(_STEP, 0x9E3779B97F4A7C15, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)
_BLOCKS = _rng.integers(1, 2**64, _STEP, np.uint64, endpoint=False) | np.uint64(1)
# The first block is 1, so that a hash is the same beside longer words or runs.
_BLOCKS[0] = 1
_ORDER = _rng.integers(1, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_one(h: int) -> int:
    """``mix`` of one number."""
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 31


class Words:
    """All words of some texts: hashes, first and last byte places in ``data``, and each text's first word (and the end)."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        self.first_bytes = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=self.first_bytes[1:])
        raw = b"\n".join(parts) + b"\n"
        self.data = np.frombuffer(raw, np.uint8)
        space = _SPACE[self.data]
        self.starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        self.ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        self.firsts = np.searchsorted(self.starts, self.first_bytes)
        self.hashes = np.zeros(0, np.uint64)
        if len(self.starts):
            head = self.starts[0]
            place = np.arange(len(raw) - head) - np.repeat(self.starts - head, np.diff(np.append(self.starts, len(raw))))
            values = _BYTE[np.frombuffer(raw.lower(), np.uint8)[head:]] * _powers(place)
            values[space[head:]] = 0
            sizes = (self.ends - self.starts).astype(np.uint64)
            self.hashes = mix(np.add.reduceat(values, self.starts - head) + sizes)


def _powers(place: np.ndarray) -> np.ndarray:
    """A factor for each place, for sums that depend on order."""
    out = _POWERS[place & (_STEP - 1)]
    if len(place) and place.max() >= _STEP:
        out = out * _BLOCKS[(place >> 12) & (_STEP - 1)]
    return out


def run_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-dependent hashes of the runs of words that begin at ``starts``, the first at 0, and reach to the next."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(hashes * _powers(place), starts) + sizes.astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        out += hashes[k: k + len(out)] * _ORDER[k]
    return mix(out)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one, without words none."""
    words = Words(texts)
    hashes, firsts, whole = words.hashes, words.firsts, windows(words.hashes, size)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= size:
            out.append(np.unique(whole[a: b - size + 1]))
        elif b > a:
            short = (hashes[a:b] * _ORDER[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Characters worked on at once where arrays hold some fifty bytes for each.
WORKING_CHARS = 2_000_000


def pieces(texts: list[str | None], limit: int = 4_000_000):
    """Runs of texts with about ``limit`` characters, so that working arrays stay small."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= limit:
            yield texts[start: i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:]
