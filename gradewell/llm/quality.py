"""Quality rules: plain base counts, and divergence from the usual text of a language.

A document's histograms of character classes and of its language's common words
are compared with those of all documents of that language by Jensen-Shannon
distance (base 2, so 0 to 1).  Everything is built-in functions over columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.session import materialize

SPACE = r"[\x20\x09-\x0D]"
#: Character classes by pattern; what none of them matches is one more class.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": "[.,;:!?'\"()-]", "symbol": "[#*$%&|<>]", "space": SPACE}
#: A common word makes up at least one in so many words of its language, so there are at most so many.
COMMON_SHARE = 200
#: Largest distances of a document that stays.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.3
#: Shorter documents are not judged by characters or words.
MIN_CHARS, MIN_WORDS = 200, 100
#: A language with fewer documents has no reference, and its documents are not judged.
MIN_DOCUMENTS = 20
#: What no class but "space" counts and most of a text consists of.
_PLAIN = r"[a-z\x20\x09-\x0D\p{Ll}\p{Lo}]+"
#: Common words of a language are looked up in so many parts, a power of two.
_PARTS = 64
_PLACE = 24


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def _count(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


def _part(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(_PARTS - 1)).cast("int")


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def three_word_runs(words: Column) -> Column:
    """Hashes of all runs of three words."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    h = F.transform(words, lambda w: F.xxhash64(w))
    first = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(first, F.slice(h, F.lit(3), n), lambda x, c: F.xxhash64(x, c))


def with_repeat_words(df: DataFrame, runs: str, name: str) -> DataFrame:
    """``df`` with, as ``name`` in place of ``runs``, the words that lie in a run found twice or more.

    Runs are first sorted by the front of their hash with the place in the bits
    behind it; only those next to an equal front are compared in full.  The steps
    are columns of their own so that each is worked out once, and empty where no
    run repeats.
    """
    front = lambda x: F.shiftright(x, _PLACE)
    numbers = F.array().cast("array<bigint>")
    r = F.col(runs)
    packed = F.sort_array(F.transform(r, lambda x, i: F.shiftleft(front(x), _PLACE).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_packed", F.when(F.size(r) == F.size(F.array_distinct(r)), numbers).otherwise(packed))
    n = F.greatest(F.size("_packed") - 1, F.lit(0))
    first, second = F.slice("_packed", F.lit(1), n), F.slice("_packed", F.lit(2), n)
    beside = F.zip_with(first, second, lambda a, b: F.when(front(a) == front(b), F.array(a, b)))
    near = F.array_distinct(F.flatten(F.filter(beside, lambda x: x.isNotNull())))
    near = F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int"))
    # Places of longer texts do not fit behind the front: there all runs are compared in full.
    places = F.when(F.size(r) < (1 << _PLACE), near).otherwise(F.when(n > 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")))
    held = F.sort_array(F.transform(places, lambda i: F.struct(F.element_at(r, i + 1).alias("r"), i.alias("i"))))
    df = df.withColumn("_held", held).drop("_packed", runs)
    nothing = F.array(F.lit(None).cast("struct<r:bigint,i:int>"))
    m = F.greatest(F.size("_held") - 1, F.lit(0))
    before, after = F.concat(nothing, F.slice("_held", F.lit(1), m)), F.concat(F.slice("_held", F.lit(2), m), nothing)
    same = F.filter(
        F.arrays_zip(F.col("_held").alias("x"), before.alias("b"), after.alias("a")),
        lambda x: F.coalesce(x["x"]["r"] == x["b"]["r"], F.lit(False)) | F.coalesce(x["x"]["r"] == x["a"]["r"], F.lit(False)))
    words = F.flatten(F.transform(same, lambda x: F.array(*[x["x"]["i"] + k for k in range(3)])))
    return df.withColumn(name, F.when(F.size("_held") == 0, 0).otherwise(F.size(F.array_distinct(words))).cast("long")).drop("_held")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of shares."""
    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)))


def common_words(docs: DataFrame) -> DataFrame:
    """Per language its common words and their shares, from counts over every document.

    Words are counted per task before they are shuffled; a language has at most
    COMMON_SHARE common words, in ascending order; ``ref_parts`` holds them by ``_part``.
    """
    words = docs.select(_lang().alias("ref_lang"), F.explode(F.split(F.lower(_text()), f"{SPACE}+")).alias("word")).where("word <> ''")
    counts = materialize(words.groupBy("ref_lang", "word").agg(F.count("*").alias("n")), label="words")
    totals = materialize(counts.groupBy("ref_lang").agg(F.sum("n").alias("n_all")), label="language-words")
    common = counts.join(totals, "ref_lang").where(F.col("n") * COMMON_SHARE >= F.col("n_all"))
    common = common.groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("n_all")).alias("share")))).alias("common"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(_PARTS - 1)), lambda k: F.filter("common.word", lambda w: _part(w) == k))
    return materialize(common.select("ref_lang", F.col("common.word").alias("ref_words"), F.col("common.share").alias("ref_shares"), parts.alias("ref_parts")), label="common-words")


def quality(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, lang``) with counts, distances and the verdict.

    ``base_failed``: fewer than 50 words, or more than half of the words lie in
    repeated three-word runs.  ``kept``: not that, and neither distance from the
    language's reference is above its limit.  A distance is null, and judges
    nothing, where the text is too short or the language has fewer than
    MIN_DOCUMENTS documents.  A null text counts as empty (and fails), a null
    language is one of its own.  Null ids and repeated rows are rows like others.
    With ``carry`` the columns of ``docs`` come as the struct ``row`` as well.
    """
    own = ["doc_id", *(["row"] if carry else [])]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    t = F.col("text")
    rows = docs.select("doc_id", _text().alias("text"), _lang().alias("ref_lang"), *row)
    rows = rows.select(*own, "ref_lang", F.length(t).cast("long").alias("n_chars"), _words(t).alias("words"),
                       _duplicate_lines(t).alias("n_dup_lines"), F.regexp_replace(t, _PLAIN, "").alias("rest"))
    # Spaces are what words leave, all other classes are counted in what is left of the text.
    space = (F.col("n_chars") - F.length(F.array_join("words", ""))).cast("long").alias("n_space")
    counts = [space if c == "space" else _count(F.col("rest"), p).alias(f"n_{c}") for c, p in CLASSES.items()]
    rows = rows.select(*own, "ref_lang", "n_chars", "words", "n_dup_lines", *counts)
    rows = rows.join(common_words(docs), "ref_lang", "left")
    rows = rows.select("*", three_word_runs(F.col("words")).alias("runs"), F.size("words").cast("long").alias("n_words"),
                       F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: F.array_contains(F.element_at("ref_parts", _part(w) + 1), w)).alias("hits"))
    # Sorted with each common word added once, hits stand in as many stretches as there are common words.
    rows = rows.withColumn("stretches", F.sort_array(F.concat("hits", "ref_words")))
    rows = rows.withColumn("starts", F.transform("ref_words", lambda r: F.array_position("stretches", r)))
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(0))), F.array(F.size("stretches").cast("long") + 1))
    found = F.transform(F.zip_with("starts", ends, lambda a, b: b - a - 1), lambda n: n / F.col("n_words"))
    found = F.concat(found, F.array(1 - F.size("hits") / F.col("n_words")))
    usual = F.concat("ref_shares", F.array(1 - F.aggregate("ref_shares", F.lit(0.0), lambda s, x: s + x)))
    classes = [f"n_{c}" for c in CLASSES]
    rows = rows.select(*own, "ref_lang", "n_chars", "n_words", "n_dup_lines", "runs", *classes,
                       F.when(F.col("n_words") >= MIN_WORDS, distance(found, usual)).alias("word_distance"))
    rows = materialize(with_repeat_words(rows, "runs", "n_repeat_words"), label="quality")

    def shares(n: Column, parts: list[Column]) -> Column:
        return F.array(*[p / n for p in parts], (n - sum(parts[1:], parts[0])) / n)

    totals = rows.groupBy("ref_lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("all_chars"), *[F.sum(c).alias(f"all_{c}") for c in classes])
    totals = totals.where((F.col("n_docs") >= MIN_DOCUMENTS) & (F.col("all_chars") > 0))
    usual = shares(F.col("all_chars"), [F.col(f"all_{c}") for c in classes])
    rows = rows.join(materialize(totals.select("ref_lang", usual.alias("ref_classes")), label="language-classes"), "ref_lang", "left")
    judged = F.col("ref_classes").isNotNull()
    rows = rows.select(
        *own, "n_words", (F.col("n_chars") - F.col("n_space")).alias("word_chars"), F.col("n_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.when(judged & (F.col("n_chars") >= MIN_CHARS), distance(shares(F.col("n_chars"), [F.col(c) for c in classes]), F.col("ref_classes"))).alias("class_distance"),
        F.when(judged, F.col("word_distance")).alias("word_distance"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))
    close = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & close)


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they are."""
    return quality(docs, carry=True).where("kept").select("row.*")
