"""Token sequences packed by bin completion.

Bins of one capacity are filled from a histogram of piece lengths, which has at
most ``capacity`` entries however many documents there are.  A step takes the
largest length left, enumerates the undominated fillings of the room beside it,
and applies the chosen filling as often as the counts allow.  The search goes
depth first over steps; its first solution is best fit, which is the incumbent,
and a branch ends when the waste of its closed bins exceeds what a better
solution could afford.  Pieces then find their sequence by their rank among the
pieces of equal length, from per-partition counts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.hashing import pieces as runs
from gradewell.llm.workers import kept
from gradewell.session import materialize

CAPACITY = 2048
#: Fillings tried beside one largest length, and nodes of their enumeration.
CHOICES, FILL_NODES = 6, 600
#: Steps of the whole search before the incumbent is taken.
SEARCH_STEPS = 10_000
#: Words kept with their ids in one worker.
CACHED_WORDS = 900_000
_PLACE_BITS = 33

def _tokenizer(path: str) -> tuple:
    """The tokenizer at ``path``, its words' ids, and whether a text's ids are those of its words; once per worker."""
    loaded = kept("tokenizers")
    if path not in loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        loaded[path] = (tokenizer, {}, by_words(json.loads(tokenizer.to_str())))
    return loaded[path]


#: What the pre-tokenizer's pattern may be for texts to be taken apart at white space: runs of letters, single numbers, runs of other signs.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a tokenizer drops white space, joins nothing across it, and has lower case and the word pattern above.

    Only then words are encoded once each; with any other tokenizer whole texts are encoded.
    """
    def steps(part: dict | None, key: str) -> list[dict]:
        return part[key] if part and part["type"] == "Sequence" else [part] if part else []

    first = (steps(spec["pre_tokenizer"], "pretokenizers") or [{}])[0]
    drops = (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True) and first["pattern"] == {"Regex": _WORD_PATTERN}
    normal = steps(spec["normalizer"], "normalizers")
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    known = [n["type"] in ("NFC", "Lowercase") or n == spaces for n in normal]
    special = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"])]
    return drops and all(known) and {"type": "Lowercase"} in normal and not special and not spec["truncation"] and not spec["padding"]


#: Python takes these for white space, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: A sign that words are set apart with when many are encoded at once, and how many.
_SIGN, _TOGETHER = "~", 50
#: Signs that often follow a word.
_TAIL = ".,;:!?%$#&*|"


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _parts(word: str) -> tuple[str, ...]:
    """A word as parts that the tokenizer takes apart as well: letters, and a run of signs behind them.

    Letters that end in a mark once they are composed or in lower case, as U+0130
    does, are joined with what follows; such words stay whole.
    """
    core = word.rstrip(_TAIL)
    if len(core) == len(word) or not core.isalpha():
        return (word,)
    if not core.isascii() and not unicodedata.normalize("NFC", core).lower().isalpha():
        return (word,)
    return (core, word[len(core):])


def _encode_words(tokenizer, words: list[str]) -> dict[str, bytes]:
    """Ids of each word; words are encoded many at a time with a sign of one id between them."""
    sign = tokenizer.encode(_SIGN, add_special_tokens=False).ids
    plain = [w for w in words if _SIGN not in w] if len(sign) == 1 else []
    groups = [plain[i: i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
    out = {}
    between = f" {_SIGN} "
    for group, found in zip(groups, tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(found.ids, "<u4")
        data, ends = ids.tobytes(), np.flatnonzero(ids == sign[0]).tolist()
        if len(ends) == len(group) - 1:
            out.update(zip(group, [data[4 * a: 4 * b] for a, b in zip([0, *[e + 1 for e in ends]], [*ends, len(ids)])]))
    rest = [w for w in words if w not in out]
    out.update(zip(rest, (_pack(e.ids) for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False))))
    return out


def _words(text: str) -> list[str]:
    """Words, in lower case where that changes no id: in plain letters without the opening of a special token."""
    return (text.lower() if text.isascii() and "<|" not in text else text).split()


def token_ids(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    Where the tokenizer drops white space and never joins across it, a text's ids
    are those of its words in order, and each distinct word is encoded once;
    otherwise, and for texts with separators that only Python takes for white
    space, whole texts are encoded.
    """
    tokenizer, known, words_do = _tokenizer(path)
    if not words_do:
        for i in range(0, len(texts), 1000):
            for found in tokenizer.encode_batch_fast([t or "" for t in texts[i: i + 1000]], add_special_tokens=False):
                yield _pack(found.ids)
        return
    if len(known) > CACHED_WORDS:
        known.clear()
    split = [_words(t) if t else [] for t in texts]
    new = {w: _parts(w) for w in set().union(*split).difference(known)}
    unknown = list({part for parts in new.values() for part in parts}.difference(known))
    for i in range(0, len(unknown), 20_000):
        known.update(_encode_words(tokenizer, unknown[i: i + 20_000]))
    for w, parts in new.items():
        if len(parts) > 1:
            known[w] = known[parts[0]] + known[parts[1]]
    for text, ws in zip(texts, split):
        if text and _ODD_SPACE.search(text):
            yield _pack(tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            yield b"".join(map(known.__getitem__, ws))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for part in runs(texts, 6_000_000):
                rows = []
                for doc, data in zip(ids[at: at + len(part)], token_ids(part, path)):
                    data += b"\0\0\0\0"
                    step = 4 * capacity
                    for k in range(0, len(data), step):
                        own = data[k: k + step]
                        rows.append((doc, k // step, k // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                at += len(part)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def fillings(left: np.ndarray, room: int, largest: int) -> list[tuple[list[int], int]]:
    """Undominated fillings of ``room`` from the histogram ``left``, by waste; the CHOICES best of those met in FILL_NODES steps.

    A filling is dominated if a length that is left could be added, or could take
    the place of a smaller one in it.  The first one tried takes the largest length
    that fits, again and again.
    """
    lengths = np.flatnonzero(left[: min(room, largest) + 1]).tolist()
    found: list[tuple[list[int], int]] = []
    used: dict[int, int] = {}
    nodes = 0

    def dominated(chosen: list[int], space: int) -> bool:
        """Whether some length left is more than one of ``chosen``, or than nothing, by ``space`` at most."""
        for c in {0, *chosen}:
            for k in range(bisect_right(lengths, c), len(lengths)):
                if lengths[k] - c > space:
                    break
                if left[lengths[k]] > used.get(lengths[k], 0):
                    return True
        return False

    def descend(chosen: list[int], space: int, place: int) -> bool:
        """Whether enough was found."""
        nonlocal nodes
        nodes += 1
        if not dominated(chosen, space):
            found.append((chosen, space))
            if sum(waste == 0 for _, waste in found) >= CHOICES:
                return True
        place = min(place, bisect_right(lengths, space))
        while place > 0 and nodes < FILL_NODES:
            length = lengths[place - 1]
            place -= 1
            if left[length] <= used.get(length, 0):
                continue
            used[length] = used.get(length, 0) + 1
            done = descend([*chosen, length], space - length, place + 1)
            used[length] -= 1
            if done:
                return True
        return nodes >= FILL_NODES

    descend([], room, len(lengths))
    if not found:
        # Out of steps: the largest that fits, again and again.
        chosen, space, rest = [], room, left.copy()
        for length in reversed(lengths):
            n = min(int(rest[length]), space // length)
            chosen, space = chosen + [length] * n, space - length * n
        found.append((chosen, space))
    return sorted(found, key=lambda x: (x[1], len(x[0])))[:CHOICES]


def _times(left: np.ndarray, bin_: list[int]) -> int:
    lengths, uses = np.unique(bin_, return_counts=True)
    return int((left[lengths] // uses).min())


def least_bins(histogram: np.ndarray, capacity: int) -> int:
    """Fewest bins there can be: by total length, and by pieces that no bin holds two of with the room they leave."""
    lengths = np.arange(len(histogram))
    best = -(-int((histogram * lengths).sum()) // capacity)
    for small in range(1, capacity // 2 + 1):
        # Pieces above capacity - small and above half have bins of their own; what lies from small to half fills the room of the latter.
        alone = int(histogram[capacity - small + 1:].sum())
        half = slice(capacity // 2 + 1, capacity - small + 1)
        middle = slice(small, capacity // 2 + 1)
        halves = int(histogram[half].sum())
        room = halves * capacity - int((histogram[half] * lengths[half]).sum())
        rest = int((histogram[middle] * lengths[middle]).sum()) - room
        best = max(best, alone + halves + max(0, -(-rest // capacity)))
    return best


def plan_bins(histogram: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), packing ``histogram[length]`` pieces into as few bins as found.

    Depth first; the first solution, best fit throughout, is the incumbent.  Then
    solutions with one choice that is not the first are looked at, then two, four
    and so on, until the lower bound is met, nothing is left to try, or
    SEARCH_STEPS steps are done.
    """
    total = int((histogram * np.arange(len(histogram))).sum())
    least = least_bins(histogram, capacity)
    best: list[tuple[list[int], int]] | None = None
    best_bins = steps = 0
    most_turns, cut = 0, True

    def after(plan: tuple | None) -> np.ndarray:
        left = histogram.copy()
        while plan:
            np.subtract.at(left, plan[0][0], plan[0][1])
            plan = plan[1]
        return left

    while cut and (best is None or (best_bins > least and steps < SEARCH_STEPS)):
        cut = False
        # Each entry: waste and bins so far, plan as a linked list, how many choices were not the first.
        stack: list[tuple] = [(0, 0, None, 0)]
        while stack and (best is None or (best_bins > least and steps < SEARCH_STEPS)):
            waste, bins, plan, turns = stack.pop()
            left = after(plan)
            while best is None or waste <= (best_bins - 1) * capacity - total:
                steps += 1
                lengths = np.flatnonzero(left)
                if not len(lengths):
                    best, best_bins, node = [], bins, plan
                    while node:
                        best.append(node[0])
                        node = node[1]
                    break
                if best is not None and steps >= SEARCH_STEPS:
                    break
                largest = int(lengths[-1])
                left[largest] -= 1
                options = fillings(left, capacity - largest, largest)
                left[largest] += 1
                moves = [([largest, *other], room, _times(left, [largest, *other])) for other, room in options]
                # The first filling as often as it can be; or another one, or any of them once only.
                others = moves[1:] + [(bin_, room, 1) for bin_, room, n in moves if n > 1]
                if others and turns >= most_turns:
                    cut = True
                else:
                    stack += [(waste + room * n, bins + n, ((bin_, n), plan), turns + 1) for bin_, room, n in reversed(others)]
                bin_, room, n = moves[0]
                np.subtract.at(left, bin_, n)
                waste, bins, plan = waste + room * n, bins + n, ((bin_, n), plan)
        most_turns = max(1, 2 * most_turns)
    return best or []


def placements(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset): who goes where, sorted."""
    rows, rank, sequence = [], {}, 0
    for bin_, n in plan:
        offset = 0
        for length in bin_:
            start = rank.get(length, 0)
            rows.append((length, start, n, sequence, offset))
            rank[length] = start + n
            offset += length
        sequence += n
    out = np.array(sorted(rows), np.int64)
    return out.reshape(-1, 5)


def _place(rows: np.ndarray):
    key = rows[:, 0] << 44 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            found = rows[np.searchsorted(key, (length << 44) | rank, "right") - 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents (``doc_id, text``) in as few sequences of at most ``capacity`` tokens as found.

    A document is its token ids and then id 0; null and empty texts are id 0
    alone.  Only longer ones are cut, into pieces of ``capacity`` and a rest.
    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``, with the ids as little-endian unsigned 32-bit numbers in ``ids`` if
    asked for.  Null ids and repeated rows are documents like others; an empty
    table gives no rows.
    """
    if not 1 <= capacity < 2**19:
        raise ValueError("capacity must be from 1 to 524287")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = source.mapInArrow(_cut(tokenizer_path, capacity, with_ids), _PIECES)
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    cut = materialize(cut.select(*own).withColumn("place", F.monotonically_increasing_id()), label="pieces")

    part = F.shiftrightunsigned("place", _PLACE_BITS)
    counts = cut.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), label="length-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    if not histogram.any():
        return cut.select(*own, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    inside = Window.partitionBy("length", "part").orderBy("place")
    ranked = cut.withColumn("part", part).withColumn("at", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts.drop("n"), ["length", "part"]).select(*own, (F.col("before") + F.col("at")).cast("long").alias("rank"))
    rows = placements(plan_bins(histogram, capacity))
    kinds = dict(cut.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in own], "sequence_id long", "offset long"])
    return ranked.mapInArrow(_place(rows), schema.replace("bigint", "long"))
