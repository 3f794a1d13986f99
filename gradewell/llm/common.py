"""Shared steps: connected components, and links found in buckets of a banded sketch.

Everything that later steps read twice is written to the shared folder first
(``gradewell.session.materialize``), so a lost executor costs a re-read only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gradewell.llm.dealing import by_key, repeated, starts
from gradewell.session import materialize, temporary

#: In buckets of up to so many ids all pairs are compared: at most (SMALL - 1) / 2 a member.
SMALL = 8
#: Words of 64 parity bits of a set, a power of two.
PARITY_WORDS = 8


def stored_with(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``df`` written and read back, and aggregates over it taken while it is written."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(name) for name, c in measures.items()]), label=label)
    return out, seen.get


def stored_or_none(df: DataFrame, label: str) -> DataFrame | None:
    """``df`` written and read back; none if it has no rows."""
    out, seen = stored_with(df, label, n=F.count(F.lit(1)))
    return out if seen["n"] else None


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each linked id, by contraction.

    ``links``: pairs ``a, b`` of long ids, in any order; self links and repeated
    pairs are allowed.  Returns ``id, label`` for every id in a pair.  Each round
    hooks an id to its smallest neighbour, follows these pointers to their end and
    goes on with the links between what is left; a hub costs one partially
    aggregated minimum, and joins read two plain shuffles, which adaptive
    execution can split.  No links: no rows.
    """
    with temporary(links.sparkSession) as keep:
        return keep(materialize(_contracted(links.select("a", "b")), label="components"))


def _contracted(edges: DataFrame) -> DataFrame:
    labels = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("label"))
        parents = _follow(materialize(parents, label="parents"))
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = materialize(
                labels.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label")), label="labels")
        a, b = (parents.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab")
        left = edges.join(a, "a").join(b, "b").where("a_label <> b_label")
        edges = stored_or_none(left.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), "links")
        if edges is None:
            return labels


def _follow(pointers: DataFrame) -> DataFrame:
    """Pointer doubling: every id's label becomes the end of its chain."""
    moved = 1
    while moved:
        step = pointers.select(F.col("id").alias("label"), F.col("label").alias("next"))
        pointers = pointers.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"),
                                                               (F.col("next") < F.col("label")).alias("moved"))
        pointers, seen = stored_with(pointers, "pointers", moved=F.count_if("moved"))
        pointers, moved = pointers.select("id", "label"), seen["moved"]
    return pointers


def open_members(members: DataFrame) -> DataFrame:
    """The distinct ``key, id`` rows of buckets that hold more than one id, stored, with ``other``.

    ``other`` is the other id of a bucket of two rows, and null elsewhere.  Rows are
    shuffled once, many of them in one Spark row.
    """
    rows = members.where("key is not null")
    return materialize(by_key(rows, ["key", "id"], _open, "key long, id long, other long"), label="members")


def _open(key: np.ndarray, ids: np.ndarray) -> pa.Table:
    rows = repeated(key)
    rows = rows[np.lexsort((ids[rows], key[rows]))]
    key, ids = key[rows], ids[rows]
    first = np.flatnonzero(starts(key))
    sizes = np.diff(np.append(first, len(key)))
    last = first + sizes - 1
    several = np.repeat(ids[first] < ids[last], sizes)
    two = np.repeat(sizes == 2, sizes)
    other = np.repeat(ids[first] + ids[last], sizes) - ids
    keep = several & starts(key, ids)
    return pa.table({"key": key[keep], "id": ids[keep], "other": pa.array(other[keep], mask=~two[keep])})


def prefix_pairs(ids: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Pairs ``a, b`` that may reach ``percent`` Jaccard similarity, of ids with different labels.

    ``ids``: ``id, label``; ``sets`` gives ``id, n, items`` (distinct longs) of ids.  With all
    items in one order, rare ones first, two sets that similar share one of their
    first ``n - ceil(n * percent / 100) + 1`` items, and the first one they share
    leaves enough items behind it in both.  Copies that differ from all others
    have their own items in front and meet nobody, so a large family costs its
    members, not its pairs; within a shared item the pairs of its most frequent
    label are left out.  A pair must also be near by parity: of bits that items
    toggle, as many differ at most as items do.  No pair that similar is lost.
    """
    rows = ids.join(sets(ids.select("id")), "id").select("id", "label", "n", F.explode("items").alias("item"))
    rows = materialize(rows, label="items")
    often = materialize(rows.groupBy("item").agg(F.count("*").alias("f")), label="item-counts")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("item").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright("item", 6).bitwiseAND(F.lit(PARITY_WORDS - 1))
    parity = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"parity{k}") for k in range(PARITY_WORDS)]
    bits = [f"parity{k}" for k in range(PARITY_WORDS)]
    ordered = rows.join(often, "item").groupBy("id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("items"), *parity)
    prefix = ordered.select("id", "label", "n", *bits, F.posexplode(F.slice("items", F.lit(1), first.cast("int"))).alias("place", "x")).where("x.f > 1")
    prefix = materialize(prefix.select("id", "label", *bits, (F.col("n") - F.col("place")).alias("left"), "n", F.col("x.item").alias("item")), label="prefixes")
    shares = prefix.groupBy("item", "label").agg(F.count("*").alias("n"))
    usual = shares.groupBy("item").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    usual = materialize(usual.select("item", F.col("top.label").alias("usual")), label="item-labels")
    other = prefix.select("item", *[F.col(c).alias(f"{c}_2") for c in ("id", "label", "left", "n", *bits)])
    few = materialize(prefix.join(usual, "item").where("label <> usual").drop("usual"), label="few")
    need = (F.col("n") + F.col("n_2")) * percent / (100 + percent) - 1e-9
    differ = [F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_2"))) for b in bits]
    close = sum(differ[1:], differ[0]) <= (F.col("n") + F.col("n_2")) * (100 - percent) / (100 + percent) + 1e-9
    near = (F.col("label") != F.col("label_2")) & (F.least("left", "left_2") >= need) & close
    return few.join(other, "item").where(near).select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()


def link_in_buckets(members: DataFrame, verify: Callable[[DataFrame, DataFrame | None], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int, rounds: int = 2) -> DataFrame:
    """Components of the ids that ``verify`` links, with candidates from shared buckets.

    ``members``: what ``open_members`` gives; ``sets`` gives the ``id, n, items`` of
    a table of distinct ids.  ``verify`` gets pairs and, the first time, the distinct
    ids that later pairs and ``sets`` are limited to (none if nothing follows).
    In small buckets all pairs are compared.  A large one usually holds one family of copies, so its pairs are not listed: in each round every large
    bucket that spans several components takes one member as its centre, and the
    members of other components are compared with that one only.  What is left
    of large buckets after ``rounds`` rounds goes through ``prefix_pairs``, which
    loses no link between different components, whatever the size of a bucket.

    Returns ``id, label`` of linked ids.
    """
    with temporary(members.sparkSession) as keep:
        return keep(_linked(members, verify, sets, percent, rounds))


def _linked(members: DataFrame, verify: Callable[[DataFrame, DataFrame | None], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int, rounds: int) -> DataFrame:
    twos = members.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    more = members.where("other is null").select("key", "id")
    sizes = materialize(more.groupBy("key").agg(F.count("*").alias("n")), label="bucket-sizes")
    other = more.select("key", F.col("id").alias("head"))
    small = more.join(sizes.where(F.col("n") <= SMALL), "key").join(other, "key").where("id < head")
    large = stored_or_none(more.join(sizes.where(F.col("n") > SMALL).select("key"), "key"), "large-buckets")
    pairs = twos.unionByName(small.select(F.col("id").alias("a"), F.col("head").alias("b")))
    rest_ids = None if large is None else materialize(large.select("id").distinct(), label="large-ids")
    links, labels = None, None
    for turn in range(rounds + 1):
        if large is not None:
            rows = large.withColumn("label", F.col("id"))
            if labels is not None:
                rows = large.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            rows = materialize(rows.select("key", "id", "label"), label="labelled")
            order = F.xxhash64("id", F.lit(turn))
            centres = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(order).alias("first"))
            centres = stored_or_none(centres.where("lo < hi").select("key", "first"), "centres")
            if centres is None and turn:
                break
            if centres is not None:
                rest = materialize(rows.join(centres, "key"), label="open-buckets")
                if turn == rounds:
                    star = prefix_pairs(rest.select("id", "label").distinct(), sets, percent)
                else:
                    heads = rest.where(order == F.col("first")).select("key", F.col("id").alias("head"), F.col("label").alias("head_label"))
                    star = rest.join(materialize(heads, label="heads"), "key").where("label <> head_label")
                    star = star.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
                pairs = star if turn else pairs.union(star)
        found = materialize(verify(materialize(pairs.distinct(), label="pairs"), None if turn else rest_ids).select("a", "b"), label="found")
        links = found if links is None else links.union(found)
        labels = components(links)
        if large is None:
            break
    return labels
