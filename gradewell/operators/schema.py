"""Column checks, renames and defaults.  All are projections: no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import stringify


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` naming the columns ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def require_distinct(names: Iterable[str], reserved: Iterable[str] = ()) -> None:
    """Raise ``ValueError`` when names clash with each other or with reserved ones.

    Spark resolves names in any case, so ``id`` and ``ID`` clash.
    """
    seen = {r.lower() for r in reserved}
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"column {name!r} clashes with another column or a reserved name")
        seen.add(name.lower())


def fresh(df: DataFrame, name: str) -> str:
    """``name`` or a longer one that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_column(df: DataFrame, name: str, null_text: str | None = "None") -> Column:
    """Column ``name`` as text, printed by its type."""
    return stringify(quoted(name), df.schema[name].dataType, null_text)


def text_fields(df: DataFrame, mapping: Mapping[str, str] | None = None, null_text: str | None = "None") -> dict[str, Column]:
    """Text columns by upper-cased slot name.

    ``mapping`` is slot to column; without one every column is its own slot.
    """
    mapping = mapping or {c: c for c in df.columns}
    require_columns(df, *mapping.values())
    return {slot.upper(): text_column(df, column, null_text) for slot, column in mapping.items()}


def upper_fields(df: DataFrame, mapping: Mapping[str, str] | None = None, keep: str | None = None) -> DataFrame:
    """Every field as text under its upper-cased name; ``keep`` stays as it is, as text."""
    mapping = mapping or {c: c for c in df.columns if c != keep}
    kept = [] if keep is None else [text_column(df, keep).alias(keep)]
    require_distinct([keep] * len(kept) + [slot.upper() for slot in mapping])
    return df.select(*kept, *[c.alias(name) for name, c in text_fields(df, mapping).items()])


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill nulls of the named output columns."""
    require_columns(df, *defaults)
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(v)) for c, v in defaults.items()})
