"""Small tables with the odd cases every operator has to bear."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["label", "id", "key", "kept", "row", "component_id", "place", "words", "_cut", "_gone", "h", "unit"]


def words(seed: int, n: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdeilmnorstu") for _ in range(pick.randint(2, 9))) for _ in range(n)]


def prose(seed: int, n: int, per_sentence: int = 9) -> str:
    """Made-up sentences; a line break after every fourth."""
    out, own = [], words(seed, n)
    for i in range(0, n, per_sentence):
        s = " ".join(own[i: i + per_sentence])
        out.append(s[0].upper() + s[1:] + "." + ("\n" if i // per_sentence % 4 == 3 else " "))
    return "".join(out).strip()


def table(spark: SparkSession, rows: list[tuple], extra: bool = True) -> DataFrame:
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names operators might use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in CLASHES if extra else []:
        df = df.withColumn(name, df.doc_id.cast("string"))
    return df


LONG = " ".join(words(99, 60_000))
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "two words"), (905, LONG), (None, "no id at all"),
       (906, "same row"), (906, "same row"), (907, "\x1c\x00 ünïcödé 𝔘 <|endoftext|> </turn> \\ # %")]
