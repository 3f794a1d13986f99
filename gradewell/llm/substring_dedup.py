"""Passages that repeat across documents: paragraph MinHash banding, verified, and removed by component.

Paragraphs are lines of eight words or more; where a line has several sentences,
those of eight words or more are units of their own, so that a passage is found
inside a longer line as well.  Units with the same words are one class.  Lines and
sentences are sketched by 12 minima of their five-word shingles in six bands of
two: two units with a Jaccard similarity of 0.8 share none once in 450 times.
(Sentences of less than BANDED_SENTENCE words are matched by equal words alone: a
word changed inside leaves none of them 0.8 alike.)  Candidates are verified on
their shingle sets, linked ones form a component, and of each component only the
first unit in the order of ids and places stays.  Of equal texts only one is cut
into units; the others go as a whole.

Where a common passage begins or ends inside a sentence, its words decide: every
run of MIN_STRETCH words that an earlier place holds is found, whatever the lines.
Anchors are the ANCHOR-word windows with the least hash among all those of some
MIN_STRETCH words, so equal runs have equal anchors; only runs with an anchor that
comes twice are compared.  All words of repeated runs go but the first ones.  What
is cut from a text is stretches of repeated units and runs of twenty words or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import link_in_buckets, open_members
from gradewell.llm.dealing import by_key, repeated, starts
from gradewell.llm.hashing import WORKING_CHARS, Words, mix, pieces, run_hashes, windows
from gradewell.operators.numbering import with_row_index
from gradewell.operators.schema import fresh, quoted
from gradewell.session import discard, materialize, materialize_by, temporary

MIN_WORDS = 8
SHINGLE = 5
#: Fewest words cut out in one place.
MIN_STRETCH = 20
#: Words of an anchor.
ANCHOR = 10
BANDS, ROWS = 6, 2
#: Words of 64 bits that shingles set, a power of two.
BIT_WORDS = 2
#: Fewest words of a sentence that is banded: in shorter ones no word can change that leaves them 0.8 alike.
BANDED_SENTENCE = 13
#: Bits of a place in a text, words or units: a text has less than 2 ** 31 bytes.  Above them stands the number of the text.
PLACE_BITS = 31
_PLACE = (1 << PLACE_BITS) - 1
_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(1, 2**64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False)
_AROUND = _rng.integers(1, 2**64, (2, MIN_STRETCH - ANCHOR), np.uint64, endpoint=False) | np.uint64(1)
_MAX = np.uint64(np.iinfo(np.uint64).max)


class Units:
    """Sentences and lines of some texts.

    ``sentences`` and ``lines`` are places of their first words; sentence numbers
    count within a text.  A unit's number is twice its first sentence's, and one
    more for a single sentence of a longer line.
    """

    def __init__(self, texts: list[str | None]):
        self.words = w = Words(texts)
        n = len(w.hashes)
        if not n:
            self.sentences = self.lines = np.zeros(0, np.int64)
            return
        line = np.cumsum(w.data == 10)[w.starts]
        new_line = np.concatenate(([True], line[1:] != line[:-1]))
        last = w.data[w.ends - 1]
        stop = (last == 46) | (last == 33) | (last == 63)  # . ! ?
        new_sentence = new_line | np.concatenate(([True], stop[:-1]))
        self.lines, self.sentences = np.flatnonzero(new_line), np.flatnonzero(new_sentence)
        self.text = np.searchsorted(w.firsts, self.sentences, "right") - 1
        self.number = np.arange(len(self.sentences)) - np.searchsorted(self.sentences, w.firsts)[self.text]
        self.sizes = np.diff(np.append(self.sentences, n))
        self.line_first = np.searchsorted(self.sentences, self.lines)
        self.line_sizes = np.diff(np.append(self.lines, n))
        self.line_sentences = np.diff(np.append(self.line_first, len(self.sentences)))

    def long_lines(self) -> np.ndarray:
        return np.flatnonzero(self.line_sizes >= MIN_WORDS) if len(self.lines) else self.lines

    def long_sentences(self) -> np.ndarray:
        """Sentences that are units of their own."""
        if not len(self.lines):
            return self.lines
        several = np.repeat(self.line_sentences > 1, self.line_sentences)
        return np.flatnonzero((self.sizes >= MIN_WORDS) & several)

    def sketches(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Band keys of these units, the bits that their shingles set, and how many shingles there are; one row each."""
        if not len(starts):
            return np.zeros((0, BANDS + BIT_WORDS + 1), np.int64)
        counts = sizes - SHINGLE + 1
        first = np.cumsum(counts) - counts
        w = windows(self.words.hashes, SHINGLE)[np.arange(counts.sum()) + np.repeat(starts - first, counts)]
        low = np.stack([np.minimum.reduceat(w * _MULTIPLY[j] + _ADD[j], first) for j in range(BANDS * ROWS)], 1)
        keys = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = mix(low[:, r::ROWS] + keys * np.uint64(0x9E3779B97F4A7C15))
        bit, word = np.uint64(1) << (w & np.uint64(63)), (w >> np.uint64(6)) & np.uint64(BIT_WORDS - 1)
        bits = [np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), first) for k in range(BIT_WORDS)]
        return np.column_stack((keys, *bits, counts.astype(np.uint64))).view(np.int64)


_BITS = [f"bits{k}" for k in range(BIT_WORDS)]
_UNITS = ", ".join(["at long, h long, keys array<long>", *[f"{c} long" for c in _BITS], "size long"])
_SETS = "id long, n long, items array<long>"


def _at(text: np.ndarray, place: np.ndarray) -> pa.Array:
    """Places that sort by text number and place."""
    return pa.array((text << PLACE_BITS) | place)


def _text(at: Column | str) -> Column:
    return F.shiftrightunsigned(at, PLACE_BITS)


def _place(at: Column | str) -> Column:
    return (F.col(at) if isinstance(at, str) else at).bitwiseAND(F.lit(_PLACE))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[str | None], np.ndarray]]:
    """Parts of batches of ``t, text``: the batch, the part's first row, its texts and their numbers."""
    for batch in batches:
        numbers, texts, first = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
        for part in pieces(texts, WORKING_CHARS):
            yield batch, first, part, numbers[first: first + len(part)]
            first += len(part)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["at", "h", "keys", *_BITS, "size"]
    for _, _, part, numbers in _numbered(batches):
        u = Units(part)
        if not len(u.lines):
            continue
        whole, single = u.long_lines(), u.long_sentences()
        first = u.line_first[whole]
        text = u.text[np.concatenate((first, single))]
        unit = np.concatenate((2 * u.number[first], 2 * u.number[single] + 1))
        starts = np.concatenate((u.lines[whole], u.sentences[single]))
        sizes = np.concatenate((u.line_sizes[whole], u.sizes[single]))
        h = np.concatenate((run_hashes(u.words.hashes, u.lines)[whole], run_hashes(u.words.hashes, u.sentences)[single])).view(np.int64)
        # Of banded units with the same words here, one is sketched; those come first.
        banded = np.flatnonzero(np.concatenate((np.ones(len(whole), bool), u.sizes[single] >= BANDED_SENTENCE)))
        sketched = banded[np.unique(h[banded], return_index=True)[1]]
        bare = np.ones(len(h), bool)
        bare[sketched] = False
        order = np.concatenate((sketched, np.flatnonzero(bare)))
        sketch = u.sketches(starts[sketched], sizes[sketched])
        n, rest = len(sketched), np.zeros(len(h) - len(sketched), np.int64)
        empty = np.arange(len(h)) >= n
        places = pa.array(np.minimum(np.arange(len(h) + 1) * BANDS, n * BANDS).astype(np.int32), mask=np.append(empty, False))
        keys = pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(sketch[:, :BANDS]).reshape(-1)))
        others = [pa.array(np.concatenate((np.ascontiguousarray(c), rest)), mask=empty) for c in sketch[:, BANDS:].T]
        yield pa.RecordBatch.from_arrays([_at(numbers[text[order]], unit[order]), pa.array(h[order]), keys, *others], names)


def _unit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the wanted units of each text."""
    for batch, at, part, _ in _numbered(batches):
        own = batch.column(2).slice(at, len(part))
        unit, text = own.flatten().to_numpy(), np.repeat(np.arange(len(part)), np.diff(own.offsets.to_numpy()))
        u = Units(part)
        if not len(unit):
            continue
        sentence = np.searchsorted(u.sentences, u.words.firsts[text]) + unit // 2
        line = np.searchsorted(u.line_first, sentence, "right") - 1
        single = unit % 2 == 1
        line_hash, sentence_hash = run_hashes(u.words.hashes, u.lines), run_hashes(u.words.hashes, u.sentences)
        h = np.where(single, sentence_hash[sentence], line_hash[line]).view(np.int64)
        start = np.where(single, u.sentences[sentence], u.lines[line])
        counts = np.where(single, u.sizes[sentence], u.line_sizes[line]) - SHINGLE + 1
        number = np.repeat(np.arange(len(unit)), counts)
        shingle = windows(u.words.hashes, SHINGLE)[np.arange(counts.sum()) + np.repeat(start - (np.cumsum(counts) - counts), counts)]
        order = np.lexsort((shingle, number))
        shingle, number = shingle[order], number[order]
        new = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (number[1:] != number[:-1])))
        sizes = np.bincount(number[new], minlength=len(unit))
        places = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(sizes), pa.ListArray.from_arrays(places, pa.array(shingle[new].view(np.int64)))], ["id", "n", "items"])


def _sliding(a: np.ndarray, size: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """``pick`` over the ``size`` values from each place on, with ``fill`` beyond the end."""
    out, span = np.concatenate((a, np.full(size, fill, a.dtype))), 1
    while 2 * span <= size:
        out, span = pick(out, np.concatenate((out[span:], np.full(span, fill, a.dtype)))), 2 * span
    if span < size:
        out = pick(out, np.concatenate((out[size - span:], np.full(size - span, fill, a.dtype))))
    return out[: len(a)]


class Anchors:
    """Of all words of some texts: anchor hashes, whether each is an anchor, and whether MIN_STRETCH words follow in its text."""

    def __init__(self, texts: list[str | None]):
        self.words = w = Words(texts)
        n, reach = len(w.hashes), MIN_STRETCH - ANCHOR + 1
        ends = np.repeat(w.firsts[1:], np.diff(w.firsts))
        self.runs = np.arange(n) + MIN_STRETCH <= ends
        self.hashes = np.full(n, _MAX)
        whole = windows(w.hashes, ANCHOR)
        self.hashes[: len(whole)] = whole
        self.hashes[np.arange(n) + ANCHOR > ends] = _MAX
        least = np.where(self.runs, _sliding(self.hashes, reach, np.minimum, _MAX), np.uint64(0))
        # A window is an anchor if a run of words that holds it has no smaller one.
        most = _sliding(least[::-1], reach, np.maximum, 0)[::-1]
        self.chosen = (most == self.hashes) & (self.hashes != _MAX)


#: Words before and behind an anchor in the runs that hold it.
SIDE = MIN_STRETCH - ANCHOR


def _room(found: Words, text: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Words before and behind the anchors that begin at words ``first``, SIDE at most."""
    return [np.minimum(first - found.firsts[text], SIDE), np.minimum(found.firsts[text + 1] - first - ANCHOR, SIDE)]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with a hash of the words around them; its last byte is how many there are before and behind."""
    for _, _, part, numbers in _numbered(batches):
        found = Anchors(part)
        first = np.flatnonzero(found.chosen)
        text = np.searchsorted(found.words.firsts, first, "right") - 1
        room = _room(found.words, text, first)
        around = np.zeros(len(first), np.uint64)
        for k in range(SIDE):
            before, behind = k < room[0], k < room[1]
            around[before] += found.words.hashes[first[before] - 1 - k] * _AROUND[0, k]
            around[behind] += found.words.hashes[first[behind] + ANCHOR + k] * _AROUND[1, k]
        around = mix(around) & ~np.uint64(255) | (room[0] << 4 | room[1]).astype(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.hashes[first].view(np.int64)), pa.array(around.view(np.int64)),
             _at(numbers[text], first - found.words.firsts[text])], ["h", "around", "at"])


_SHARED = "h long, at long, first long, start long, end long"


def _shared(h: np.ndarray, around: np.ndarray, at: np.ndarray) -> pa.Table:
    """Places of anchors that come twice: ``start, end`` of the words to remove, or ``h, first`` where it must be looked at."""
    rows = repeated(h)
    rows = rows[np.lexsort((at[rows], around[rows], h[rows]))]
    h, around, at = h[rows], around[rows], at[rows]
    new = starts(h, around)
    alike = at[new][np.cumsum(new) - 1]
    # A later place in the text of the first one may overlap it.
    copied = alike >> PLACE_BITS != at >> PLACE_BITS
    anchors = np.flatnonzero(starts(h))
    of = np.cumsum(starts(h)) - 1
    looked = ~copied & (np.bincount(of[~copied], minlength=len(anchors))[of] > 1)
    first = np.minimum.reduceat(at, anchors)[of] if len(at) else at
    place, room = at & _PLACE, [around >> 4 & 15, around & 15]
    out = copied | looked
    columns = [pa.array(c[out], mask=~m[out]) for c, m in (
        (h, looked), (at, out), (first, looked), (place - room[0], copied), (place + ANCHOR + room[1], copied))]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in _SHARED.split(", ")])


_PLACES = "h long, at long, first long, sides binary"


def _with_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted anchors with the words around them: 32 bits a word, the nearest first, those before and then those behind; 0 beyond the text."""
    reach = np.arange(SIDE)
    for batch, at, part, numbers in _numbered(batches):
        own = batch.column(2).slice(at, len(part))
        wanted, text = own.flatten(), np.repeat(np.arange(len(part)), np.diff(own.offsets.to_numpy()))
        if not len(wanted):
            continue
        place, w = wanted.field(0).to_numpy(), Words(part)
        first = w.firsts[text] + place
        short = np.maximum(w.hashes >> np.uint64(32), 1).astype(np.uint32)
        sides = np.zeros((len(place), 2, SIDE), np.uint32)
        for k, (room, word) in enumerate(zip(_room(w, text, first), (first[:, None] - 1 - reach, first[:, None] + ANCHOR + reach))):
            sides[:, k] = np.where(reach < room[:, None], short[np.clip(word, 0, len(short) - 1)], 0)
        anchors = windows(w.hashes, ANCHOR)[first].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(anchors), _at(numbers[text], place), wanted.field(1), _packed(sides)], ["h", "at", "first", "sides"])


def _packed(sides: np.ndarray) -> pa.Array:
    ends = np.arange(len(sides) + 1, dtype=np.int32) * np.int32(8 * SIDE)
    return pa.Array.from_buffers(pa.binary(), len(sides), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sides))])


def _sides(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, 2, SIDE)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the nearest words are equal."""
    differ = np.concatenate(((a != b) | (a == 0), np.ones((len(a), 1), bool)), axis=1)
    return differ.argmax(axis=1)


def _side_key(h: np.ndarray, sides: np.ndarray, side: int, n: np.ndarray) -> np.ndarray:
    """Hash of the anchor and the ``n`` nearest words of a side."""
    used = np.arange(SIDE)[None] < n[:, None]
    words = np.where(used, sides[:, side].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return mix((words * _MULTIPLY[:SIDE]).sum(axis=1) + mix(h.view(np.uint64) + np.uint64(side + 1)) + n.astype(np.uint64))


_COMPARED = "h long, at long, sides binary, before int, behind int, start long, end long, keys array<long>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors against the first place of each: the repeated stretch around it, and keys of what goes on differently.

    A run over the first different word before the anchor, or behind it, is not the
    first place's; another anchor with the same words up to that one may have it.
    """
    for batch in batches:
        h, at, first = (batch.column(c).to_numpy() for c in ("h", "at", "first"))
        place, first_place = at & _PLACE, first & _PLACE
        sides, other = _sides(batch.column("sides")), _sides(batch.column("first_sides"))
        n = [_same(sides[:, k], other[:, k]) for k in range(2)]
        start = place - n[0]
        # Where a stretch overlaps its own first place, the first run of that stays.
        own = at >> PLACE_BITS == first >> PLACE_BITS
        start = np.where(own, np.maximum(start, first_place - n[0] + MIN_STRETCH), start)
        end = place + ANCHOR + n[1]
        found = (n[0] + n[1] >= SIDE) & (start < end)
        more = np.stack([n[k] < (sides[:, k] != 0).sum(axis=1) for k in range(2)], 1)
        keys = np.stack([_side_key(h, sides, k, n[k] + 1).view(np.int64) for k in range(2)], 1)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(more.sum(axis=1))).astype(np.int32)), pa.array(keys[more]))
        out = pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("h", "at", "sides")], pa.array(n[0].astype(np.int32)), pa.array(n[1].astype(np.int32)),
             pa.array(start, mask=~found), pa.array(end, mask=~found), lists], [f.split()[0] for f in _COMPARED.split(", ")])
        yield out.filter(pa.array(found | more.any(axis=1)))


def _other_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of MIN_STRETCH words over anchors that are not those of the anchors' first places."""
    for batch in batches:
        h, at, before, behind = (batch.column(c).to_numpy() for c in ("h", "at", "before", "behind"))
        sides = _sides(batch.column("sides"))
        room = [(sides[:, k] != 0).sum(axis=1) for k in range(2)]
        for offset in range(SIDE + 1):
            rest = SIDE - offset
            own = np.flatnonzero((offset <= room[0]) & (rest <= room[1]) & ((offset > before) | (rest > behind)))
            if len(own):
                key = _side_key(h[own], sides[own], 0, np.full(len(own), offset)) + mix(_side_key(h[own], sides[own], 1, np.full(len(own), rest)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at[own] - offset)], ["h", "at"])


def _later_runs(h: np.ndarray, at: np.ndarray) -> pa.Table:
    """Words of all runs with equal words but the first one."""
    rows = repeated(h)
    rows = rows[np.lexsort((at[rows], h[rows]))]
    new, at = starts(h[rows]), at[rows]
    first = at[new][np.cumsum(new) - 1]
    place, own = at & _PLACE, at >> PLACE_BITS == first >> PLACE_BITS
    start = np.where(own, np.maximum(place, (first & _PLACE) + MIN_STRETCH), place)
    again = at != first
    return pa.table({"t": (at >> PLACE_BITS)[again], "start": start[again], "end": (place + MIN_STRETCH)[again]})


def _joined_spans(t: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """A list of spans for each text, those that overlap as one."""
    order = np.lexsort((start, t))
    t, start, end = t[order], start[order], end[order]
    # Spans of a text lie behind all those of the text before.
    behind = (np.cumsum(starts(t)) - 1) << PLACE_BITS + 1
    reach = np.maximum.accumulate(behind + end)
    new = np.append(True, (behind + start)[1:] > reach[:-1])[: len(t)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(t)) - 1
    t, spans = t[first], pa.StructArray.from_arrays([pa.array(start[first]), pa.array((reach - behind)[last])], ["start", "end"])
    texts = np.flatnonzero(starts(t))
    lists = pa.ListArray.from_arrays(pa.array(np.append(texts, len(t)).astype(np.int32)), spans)
    return pa.table({"t": t[texts], "runs": lists})


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored ``doc_id, row, t, key, text`` of each text's first id, and ``row, doc_id`` of copies with other ids.

    ``row`` is the text's hash, ``t`` its number in the order of ids and hashes.  Texts
    are shuffled once, by ``key``, a hash of id and row, and stored in its buckets.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    source = source.select("doc_id", F.xxhash64("text").alias("row"), "text")
    heads = materialize(source.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), label="texts")
    numbered = materialize(with_row_index(heads, ["doc_id", "row"], "t", stored_input=True), label="text-numbers")
    copies = source.select("doc_id", "row").join(numbered.where("n > 1").select("row", F.col("doc_id").alias("head"), "t"), "row")
    copies = materialize(copies.distinct(), label="copies")
    # An id that repeats a text holds it once.
    again = numbered.where("n > 1").select("row", "t", "n").join(copies.groupBy("t").agg(F.count("*").alias("ids")), "t").where("n > ids").select("t")
    again = materialize(again, label="repeated-rows")
    n, key = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("row", "doc_id").alias("key")
    heads = numbered.select(key, "t", F.col("row").alias("head_row"), F.col("doc_id").alias("head")).hint("shuffle_hash")
    first = source.select("doc_id", "row", key, "text").repartition(n, "key").join(heads, "key")
    # Not as equalities: joined by them as well, texts would be shuffled by all three.
    same = F.col("head_row").bitwiseXOR(F.col("row")).bitwiseOR(F.col("head").bitwiseXOR(F.col("doc_id"))) == 0
    first = first.where(same).select("doc_id", "row", "t", "key", "text")
    if not again.isEmpty():
        once = first.join(again, "t", "left_semi").dropDuplicates(["t"])
        first = first.join(again, "t", "left_anti").unionByName(once).repartition(n, "key")
    return materialize_by(first, "key", label="distinct-texts"), copies.where("doc_id <> head").select("doc_id", "row")


def _asked_texts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``t, text, wanted`` of the texts in ``asked`` (``t, wanted``); only what is asked is shuffled."""
    asked = asked.join(texts.select("t", "key"), "t").select("key", F.col("t").alias("asked_t"), "wanted")
    both = texts.select("key", "t", "text").join(asked.hint("shuffle_hash"), "key")
    return both.where(F.col("t").bitwiseXOR(F.col("asked_t")) == 0).select("t", "text", "wanted")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """Words to remove from distinct texts: ``doc_id, row`` and ``runs``, places of first words and ends.

    Every run of MIN_STRETCH words but the first one with these words in the order
    of ids, rows and places.  Where a run overlaps its own first one, the words of
    that stay.

    Of anchors with the same words around them, as far as runs reach, only the
    first one is looked at; those in later texts lose all these words.  The
    firsts are compared with the anchor's first place only, and what is equal
    around both is one stretch, a row.  Runs that leave that stretch are listed one
    by one where another anchor leaves it in the same way.
    """
    with temporary(texts.sparkSession) as keep:
        return keep(materialize(_repeated_runs(texts), label="word-cuts"))


def _repeated_runs(one: DataFrame) -> DataFrame:
    places = by_key(one.select("t", "text"), ["h", "around", "at"], _shared, _SHARED, rows=_anchors)
    places = materialize(places, label="anchors")
    copied = places.where("start is not null").select(_text("at").alias("t"), "start", "end")

    wanted = F.collect_list(F.struct(_place("at").alias("place"), "first"))
    looked = materialize(places.where("first is not null").groupBy(_text("at").alias("t")).agg(wanted.alias("wanted")), label="looked-at")
    sided = _asked_texts(one, looked).mapInArrow(_with_sides, _PLACES)
    sided = materialize(sided, label="anchor-places")
    discard(looked)
    first = sided.where("at = first").select("h", F.col("sides").alias("first_sides"))
    others = sided.where("at <> first").join(first, "h")
    compared = materialize(others.mapInArrow(_compare, _COMPARED), label="compared")
    discard(sided)
    stretches = compared.where("start is not null").select(_text("at").alias("t"), "start", "end")

    keys = compared.select("h", "at", F.explode("keys").alias("key"))
    again = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_places = keys.join(materialize(again, label="side-keys"), "key").select("h", "at").distinct()
    runs = compared.join(open_places, ["h", "at"])
    again = by_key(runs, ["h", "at"], _later_runs, "t long, start long, end long", rows=_other_runs)

    spans = copied.unionByName(stretches).unionByName(again)
    gone = by_key(spans, ["t", "start", "end"], _joined_spans, "t long, runs array<struct<start: long, end: long>>")
    return one.select("doc_id", "row", "t").join(gone, "t").select("doc_id", "row", "runs")


def without_units(text: str, gone: list[int], runs: list[dict] = ()) -> str:
    """``text`` without some units and runs of words.

    Shorter sentences between two removed units go as well, and a stretch with
    fewer than MIN_STRETCH words stays: a heading or phrase that many documents
    share is not a passage.  Lines left without words go with their break; all
    else stays as it is.
    """
    at, bounds = np.zeros(len(runs), np.int64), np.array([[r["start"], r["end"]] for r in runs], np.int64).reshape(-1, 2)
    return _without([text], np.zeros(len(gone), np.int64), np.array(gone, np.int64), at, *bounds.T)[0].as_py()


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of these spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _without(texts: list[str], unit_text: np.ndarray, units: np.ndarray, run_text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts without units and runs of words, each given with its text's place in the list."""
    u = Units(texts)
    w, n_lines, n_sentences = u.words, len(u.lines), len(u.sentences)
    if not n_lines:
        return pa.array(texts, pa.string())
    n_words = len(w.hashes)
    # A text without words has no units, and its runs end where they start.
    k = np.searchsorted(u.sentences, w.firsts[unit_text]) + units // 2
    line_of = np.repeat(np.arange(n_lines), u.line_sentences)
    cut = _covered(n_sentences, k, k + np.where(units % 2 == 1, 1, u.line_sentences[line_of[k]]))
    # Shorter sentences between removed ones go as well; stretches that stay short after that are left alone.
    places = np.flatnonzero(cut)
    if len(places) > 1:
        long_before = np.append(0, np.cumsum((u.sizes >= MIN_WORDS) & ~cut))
        p, q = places[:-1], places[1:]
        joined = (u.text[p] == u.text[q]) & (long_before[p] == long_before[q])
        cut |= _covered(n_sentences, p[joined], q[joined])
    first, last = w.firsts[run_text], w.firsts[run_text + 1]
    size = last - first
    away = np.repeat(cut, u.sizes) | _covered(n_words, first + np.minimum(starts, size), first + np.minimum(ends, size))
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.firsts))
    new = np.concatenate(([True], (away[1:] != away[:-1]) | (text_of[1:] != text_of[:-1])))
    stretch = np.flatnonzero(new)
    sizes = np.diff(np.append(stretch, n_words))
    away &= np.repeat(sizes >= MIN_STRETCH, sizes)

    # A line that loses words is made anew of the words that stay, each with the space behind it.
    gone_words = np.add.reduceat(away.astype(np.int64), u.lines)
    touched, whole = gone_words > 0, gone_words == u.line_sizes
    breaks = np.flatnonzero(w.data == 10)
    last_word = np.append(u.lines[1:], n_words) - 1
    at_break = np.searchsorted(breaks, w.ends[last_word])
    line_end = breaks[at_break]
    line_start = np.append(-1, breaks)[at_break] + 1
    # The break behind each text's last line is not its own.
    final = np.zeros(len(w.data), bool)
    final[w.first_bytes[1:] - 1] = True
    drop = _covered(len(w.data), line_start[touched], line_end[touched] + whole[touched] * ~final[line_end[touched]])
    kept = np.flatnonzero(~away & np.repeat(touched, u.line_sizes))
    word_line = np.repeat(np.arange(n_lines), u.line_sizes)
    own = word_line[kept]
    behind = np.where(kept == last_word[own], line_end[own], w.starts[np.minimum(kept + 1, n_words - 1)])
    # Where the line's last words go, the space before them goes as well.
    closing = np.append(own[1:] != own[:-1], True) if len(own) else np.zeros(0, bool)
    behind = np.where(closing & away[last_word[own]], w.ends[kept], behind)
    left = ~drop | _covered(len(w.data), w.starts[kept], behind)
    left &= ~final
    offsets = np.append(0, np.cumsum(left))[w.first_bytes]
    return pa.Array.from_buffers(
        pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(w.data[left].tobytes())]).cast(pa.string())


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows and items of lists, null ones empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _rewrite(column: int, cut: int, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, at = batch.column(column), [], 0
            listed = pc.or_(pc.is_valid(batch.column(cut)), pc.is_valid(batch.column(runs)))
            change = pc.and_(listed, pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0))
            rows = pc.indices_nonzero(change)
            if len(rows):
                old = texts.take(rows).to_pylist()
                for part in pieces(old, WORKING_CHARS):
                    own = rows.slice(at, len(part))
                    unit_text, units = _lists(batch.column(cut).take(own))
                    run_text, spans = _lists(batch.column(runs).take(own))
                    out.append(_without(part, unit_text, units.to_numpy().astype(np.int64), run_text, *[spans.field(k).to_numpy() for k in range(2)]))
                    at += len(part)
                texts = pc.replace_with_mask(texts, change, pa.concat_arrays(out).cast(texts.type))
            columns = [texts if i == column else c for i, c in enumerate(batch.columns) if i not in (cut, runs)]
            yield pa.RecordBatch.from_arrays(columns, [n for i, n in enumerate(batch.schema.names) if i not in (cut, runs)])
    return run


def repeated_units(texts: DataFrame, percent: int = 80) -> DataFrame:
    """Units to remove from distinct texts: ``doc_id, row`` and the ascending list ``units``; only texts that lose something.

    Texts without a unit of eight words lose nothing.
    """
    with temporary(texts.sparkSession) as keep:
        return keep(materialize(_repeated_units(texts, percent), label="cuts"))


def _repeated_units(texts: DataFrame, percent: int) -> DataFrame:
    units = materialize(texts.select("t", "text").mapInArrow(_units, _UNITS), label="units")
    same = units.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")

    banded = units.where("size is not null")
    members = open_members(banded.select(F.explode("keys").alias("key"), F.col("h").alias("id")))
    wanted = materialize(members.select(F.col("id").alias("h")).distinct(), label="candidates")
    # One unit stands for all with the same words.
    one = [F.min(c).alias(c) for c in ("at", *_BITS, "size")]
    holders = materialize(banded.select("h", "at", *_BITS, "size").join(wanted, "h").groupBy("h").agg(*one), label="holders")

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = holders.join(ids.select(F.col("id").alias("h")), "h").groupBy(_text("at").alias("t")).agg(F.collect_list(_place("at")).alias("wanted"))
        # Stored, so that few of them are sent to the texts.
        asked = materialize(asked, label="asked")
        sets = _asked_texts(texts, asked).mapInArrow(_unit_sets, _SETS)
        # A text's sets are made at once: no id comes twice.
        return materialize(sets, label="unit-sets")

    made = []

    def verify(pairs: DataFrame, later: DataFrame | None) -> DataFrame:
        # Each bit that is set on one side only takes a shingle of its own that the other lacks.
        for letter in "ab":
            pairs = pairs.join(holders.select(F.col("h").alias(letter), *[F.col(c).alias(f"{letter}_{c}") for c in (*_BITS, "size")]), letter)
        differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS), F.lit(0))
        likely = pairs.where(differ <= (F.col("a_size") + F.col("b_size")) * (100 - percent) / (100 + percent) + 1e-9).select("a", "b")
        likely = materialize(likely, label="likely")
        if not made:
            # Texts are read once: the sets of all that may be compared later are made with the first ones.
            ids = likely.select(F.explode(F.array("a", "b")).alias("id"))
            ids = ids if later is None else ids.unionByName(later)
            made.append(sets_of(materialize(ids.distinct(), label="likely-units")))
        sets, pairs = made[0], likely
        for letter in "ab":
            pairs = pairs.join(sets.select(F.col("id").alias(letter), F.col("n").alias(f"{letter}_n"), F.col("items").alias(f"{letter}_set")), letter)
        common = F.size(F.array_intersect("a_set", "b_set"))
        return pairs.where(100 * common >= percent * (F.col("a_n") + F.col("b_n") - common))

    labels = link_in_buckets(members, verify, lambda ids: made[0] if made else sets_of(ids), percent)
    discard(members, holders, *made)
    classes = same.join(labels.withColumnRenamed("id", "h"), "h", "full").select("h", F.coalesce("label", "h").alias("label"))
    found = materialize(units.select("at", "h").join(materialize(classes, label="classes"), "h").drop("h"), label="repeats")
    first = materialize(found.groupBy("label").agg(F.min("at").alias("first")), label="firsts")
    gone = found.join(first, "label").where("at <> first")
    gone = gone.groupBy(_text("at").alias("t")).agg(F.sort_array(F.collect_set(_place("at").cast("int"))).alias("units"))
    return texts.select("doc_id", "row", "t").join(gone, "t").select("doc_id", "row", "units")


def drop_repeated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with repeated units and runs cut out of ``text``: same rows, same columns.

    Null and empty texts and rows without an id stay as they are.  A copy of a
    whole text goes unless it has the first one's id.  Texts of rows that share an
    id are told apart.  Columns other than ``doc_id`` and ``text`` are carried along.
    """
    with temporary(docs.sparkSession) as keep:
        texts, copies = distinct_texts(docs)
        gone = repeated_units(texts, percent).join(repeated_runs(texts), ["doc_id", "row"], "full")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(2**62).alias("end")))
        gone = gone.unionByName(copies.select("doc_id", "row", whole.alias("runs")), allowMissingColumns=True)
        gone = keep(materialize(gone, label="gone"))
    cut, name, words, row, own_row = (fresh(docs, c) for c in ("_cut", "_id", "_words", "_row", "_own"))
    gone = gone.select(F.col("doc_id").alias(name), F.col("row").alias(row), F.col("units").alias(cut), F.col("runs").alias(words))
    marked = docs.withColumn(own_row, F.xxhash64(F.col("text").cast("string")))
    joined = marked.join(gone, (F.col("doc_id") == F.col(name)) & (F.col(own_row) == F.col(row)), "left").drop(name, row, own_row)
    joined = joined.select(*[quoted(c) if c != "text" else F.col("text").cast("string").alias("text") for c in joined.columns])
    columns = joined.columns
    schema = joined.drop(cut, words).schema
    return joined.mapInArrow(_rewrite(*[columns.index(c) for c in ("text", cut, words)]), schema)
