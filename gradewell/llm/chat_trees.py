"""Reply trees to training conversations.

Messages name the message they answer.  Self-joins that double their reach each
time give every message its root, depth and the score of its whole path; leaves
are ranked by that score, and the chosen leaves collect the messages above them
by the same doubled links.  Each chosen path becomes one text in which turns are
marked, control strings inside texts are escaped, and the texts to learn from are
known by place.  Built-in functions only.

Format of a turn: ``### role: text</turn>`` and a line break.  In roles and texts
a backslash is ``\\b``, ``#`` is ``\\h``, ``<`` is ``\\l``, and in roles ``:`` is ``\\c``;
so neither mark can occur inside, and every backslash starts one of these codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import stored_with
from gradewell.session import materialize

START, BETWEEN, END = "### ", ": ", "</turn>\n"
#: Code of each escaped character, the backslash first.
CODES = {"\\": "\\b", "#": "\\h", "<": "\\l"}


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in {**CODES, **({":": "\\c"} if role else {})}.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed({**CODES, ":": "\\c"}.items()):
        if plain != "\\":
            text = F.replace(text, F.lit(code), F.lit(plain))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def ranked_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best root-to-leaf paths of each conversation.

    ``messages``: ``conv_id, message_id`` (both long, together unique),
    ``parent_id``, ``role``, ``text``, ``score``.  A parent that is null or not
    there makes a root.  A path's score is the sum over its messages, null as
    zero; ties go to the smallest leaf.  Messages on a circle have no root and
    are in no path.  Returns ``conv_id, branch`` (rank from 1), ``leaf_id,
    path_score, depth`` (from 0), ``message_id, role, text``.
    """
    key = ["conv_id", "message_id"]
    nodes = messages.select(*key, "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = materialize(nodes.where("conv_id is not null and message_id is not null"), label="messages")
    there = nodes.select("conv_id", F.col("message_id").alias("parent_id"), F.lit(True).alias("there"))
    linked = nodes.join(there, ["conv_id", "parent_id"], "left")
    up = F.when(F.col("there"), F.col("parent_id"))
    hops, seen = stored_with(
        linked.select(*key, up.alias("up"), "score", F.when(up.isNotNull(), 1).otherwise(0).cast("long").alias("depth")),
        "hops-0", open=F.count("up"))
    # hops[j] leads 2^j messages up; score and depth cover what lies below that place.
    total, levels = nodes.count(), [hops]
    while seen["open"] and 2 ** len(levels) <= 2 * total:
        above = hops.select("conv_id", F.col("message_id").alias("up"), F.col("up").alias("up2"),
                            F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        hops = hops.join(above, ["conv_id", "up"], "left").select(
            *key, F.col("up2").alias("up"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        hops, seen = stored_with(hops, f"hops-{len(levels)}", open=F.count("up"))
        levels.append(hops)
    parents = levels[0].select("conv_id", F.col("up").alias("message_id")).where("message_id is not null")
    leaves = hops.where("up is null").join(parents.distinct(), key, "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), "message_id")
    chosen = leaves.withColumn("branch", F.row_number().over(best).cast("long")).where(F.col("branch") <= keep)
    paths = materialize(chosen.select("conv_id", "branch", F.col("message_id").alias("leaf_id"),
                                      F.col("score").alias("path_score"), "depth", "message_id"), label="paths-0")
    # Every number of steps is a sum of powers of two: the union with what lies 2^j above covers them all.
    for level in reversed(range(len(levels) - 1)):
        jump = levels[level].select(*key, "up").where("up is not null")
        above = paths.join(jump, key).select("conv_id", "branch", "leaf_id", "path_score",
                                             (F.col("depth") - 2**level).alias("depth"), F.col("up").alias("message_id"))
        paths = materialize(paths.unionByName(above), label=f"paths-{level + 1}")
    return paths.join(messages.select(*key, "role", "text"), key)


def format_paths(paths: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One text per path, and the places in it to learn from.

    ``paths``: as from ``ranked_paths``.  Returns ``conv_id, branch, n_turns,
    formatted, loss_spans``: spans hold ``start`` (from 1) and ``length`` in code
    points and cover the escaped texts of ``learn_role`` turns, without any mark.
    Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escape(role, role=True), F.lit(BETWEEN))
    turns = paths.select("conv_id", "branch", "depth", head.alias("head"), escape(text).alias("body"), (role == learn_role).alias("learn"))
    turn = F.struct("depth", "head", "body", "learn")
    convs = turns.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    size = len(END)
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + size).alias("at"),
            F.when(t["learn"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return convs.select("conv_id", "branch", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"), walked.alias("loss_spans"))


def parsed_turns(formatted: Column) -> Column:
    """Roles and texts read back from a formatted conversation."""
    turns = F.split(formatted, END, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substr(t, F.lit(len(START) + 1), F.locate(BETWEEN, t, len(START) + 1) - len(START) - 1)).alias("role"),
        unescape(F.substr(t, F.locate(BETWEEN, t, len(START) + 1) + len(BETWEEN))).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the spans, unescaped and joined without anything between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))))


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (``conv_id, turn, role, text``): each answers the one before.

    Rows with the same turn follow each other by role and text; a null turn comes
    first, and rows without a conversation are left out.  Every message scores
    its length.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.where("conv_id is not null").select("conv_id", place.alias("message_id"), "role", "text")
    return rows.select("*", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"),
                       F.length("text").cast("double").alias("score"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Formatted conversations, one row each, with digests of what is read back from the output."""
    messages = materialize(chains(conversations), label="chains")
    out = materialize(format_paths(ranked_paths(messages)), label="formatted")
    read = out.select("conv_id", "formatted", parsed_turns(F.col("formatted")).alias("turns"),
                      learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "formatted")
