"""Tables in and out: splits, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.operators.schema import quoted, require_columns

_CSV = {"header": True, "quote": '"', "escape": '"'}


def read_split(spark: SparkSession, root: str, split: str, fmt: str = "parquet", split_col: str | None = None) -> DataFrame:
    """One split of a dataset: the folder of that name, or with ``split_col``
    the rows of that partition, of which only the folder is read."""
    reader = spark.read.format(fmt)
    if split_col is None:
        return reader.load(f"{root}/{split}")
    return reader.load(root).where(quoted(split_col) == split).drop(split_col)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, so that an id ``007`` stays one.

    Texts may hold line breaks, so a file is read by one task: turn large files
    into parquet once, with ``csv_to_parquet``.  ``columns`` spares the look at
    the header and fails where it differs.
    """
    reader = spark.read.options(**_CSV, multiLine=True)
    if columns:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def csv_to_parquet(spark: SparkSession, csv_path: str, path: str, columns: list[str] | None = None) -> DataFrame:
    read_csv(spark, csv_path, columns).write.parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, id_col: str = "id") -> None:
    """CSV with the id first, white space around values kept."""
    require_columns(df, id_col)
    rest = [quoted(c) for c in df.columns if c != id_col]
    df.select(quoted(id_col), *rest).write.options(
        **_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str, keyed_by: str | None = None) -> None:
    """One JSON record per line, nulls and non-ASCII text included.

    With ``keyed_by`` each line is an object of one entry, the record under its
    key, as in one large object keyed by id but written in parallel.
    """
    if keyed_by is None:
        df.write.option("ignoreNullFields", False).json(path)
        return
    require_columns(df, keyed_by)
    record = F.struct(*[quoted(c) for c in df.columns])
    entry = F.create_map(quoted(keyed_by).cast("string"), record)
    df.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_keyed_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of ``write_json(..., keyed_by=…)``."""
    entries = F.from_json("value", T.MapType(T.StringType(), schema))
    return spark.read.text(path).select(F.explode(entries).alias("key", "record")).select("record.*")
