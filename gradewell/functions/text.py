"""Column functions over model text.

Everything here is a built-in expression: it runs inside the JVM and
reads its input once.  The cost stays linear in the text, also for hostile input:
a section that is opened but never closed swallows the rest of the text, so that
thousands of such openings are not each searched to the end, and white space is
trimmed by character set instead of by backtracking.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.fixed import WHITESPACE

_BOXED = r"\\boxed\{([^{}]+)\}"

# The captured body keeps its last line break, so a match is never empty.
_CODE = r"(?s)```python\n(?:(.*?\n)```|.*+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop Unicode white space from both ends (plain ``trim`` drops only spaces)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def clean_text(c: Column | str) -> Column:
    """Drop blank lines, strip each line and the whole; null becomes ''."""
    lines = F.transform(F.split(_col(c), "\n"), strip)
    return F.coalesce(F.array_join(F.filter(lines, lambda line: line != ""), "\n"), F.lit(""))


def tagged_section(c: Column | str, tag: str) -> Column:
    """Stripped body of the first ``<tag>…</tag>``, '' without one, null for null.

    Tag names match in any case.  The first opening decides: when it is never
    closed, no later one is closed either.
    """
    t = re.escape(tag)
    return strip(F.regexp_extract(_col(c), rf"(?s)<(?iu:{t})>(?:([^<]*+.*?)</(?iu:{t})>|.*+)", 1))


def boxed_answer(c: Column | str) -> Column:
    r"""Last ``\boxed{…}`` body, stripped; null when there is none.

    Bodies with braces never match and neither does an empty one; a blank body
    gives ''.
    """
    found = F.regexp_extract_all(_col(c), F.lit(_BOXED), F.lit(1))
    return strip(F.try_element_at(found, F.lit(-1)))


def code_block(c: Column | str) -> Column:
    """Body of the first fenced python block; null when there is none."""
    body = F.nullif(F.regexp_extract(_col(c), _CODE, 1), F.lit(""))
    return F.regexp_replace(body, r"\n\z", "")


def append_tool_output(c: Column | str, result: Column | str) -> Column:
    """Text followed by the result of the code it holds and a closing fence."""
    return F.concat(_col(c), F.lit("\n"), _col(result), F.lit("\n```"))


def _python_float(text: Column) -> Column:
    """Lay out the JVM's text of a double the way ``str(float)`` does.

    The digits are the JVM's: before Java 19 it prints one digit more than
    needed for some very large and very small values.
    """
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    power = F.abs(exponent).cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    # 17 digits before and 21 behind the point cover what is printed in full.
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    scientific = F.concat(
        sign,
        digits,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")),
    )
    return (
        F.when(text == "NaN", F.lit("nan"))
        .when(text == "Infinity", F.lit("inf"))
        .when(text == "-Infinity", F.lit("-inf"))
        .when(~text.contains("E"), text)
        .when((exponent >= -4) & (exponent < 16), plain)
        .otherwise(scientific)
    )


def stringify(c: Column | str, dtype: T.DataType | None = None, null_text: str | None = "None") -> Column:
    """Text of any value; null becomes ``null_text`` (``None`` keeps the null).

    Booleans, floating point numbers and times print as Python prints them.  Arrays,
    structs and maps print as JSON.  Without ``dtype`` the plain cast is used.
    """
    c = _col(c)
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        text = _python_float(c.cast("string"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # A fraction of a second always has six digits.
        text = c.cast("string")
        text = F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return text if null_text is None else F.coalesce(text, F.lit(null_text))


def _expanded(slot: str, values: Mapping[str, Column]) -> Column:
    """The value of a slot with the slots that come after it filled in."""
    later = list(values)[list(values).index(slot) + 1:]
    text = value = values[slot]
    for other in later:
        text = F.replace(text, F.lit("{{" + other + "}}"), values[other])
    return F.when(value.contains("{{"), text).otherwise(value) if later else value


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Replace every ``{{slot}}`` by its value, slot after slot in the given order.

    Replacement is literal.  A value that itself holds a later slot is expanded
    too; slots without a value stay as they are.  A null value makes the text
    null, so pass values through ``stringify`` first.

    The pieces of the template and the values are put together in one step, and
    a value is searched for slots only where it holds "{{".  Where a mark could
    form across the end of a value, because slots touch or the template goes on
    with braces or letters, the slots are replaced one by one instead.
    """
    marks = {"{{" + slot + "}}": slot for slot in values}
    if not marks:
        return F.lit(template)
    pieces = re.split("(" + "|".join(map(re.escape, marks)) + ")", template)
    inside_marks = set("".join(marks))
    # Every second piece is a mark; the first and last literal may be empty.
    joints = [piece[0] for piece in pieces[2::2] if piece] + [piece[-1] for piece in pieces[:-1:2] if piece]
    apart = all(pieces[2:-1:2]) and inside_marks.isdisjoint(joints)
    if apart:
        return F.concat(*[
            _expanded(marks[piece], values) if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)])
    text = F.lit(template)
    for mark, slot in marks.items():
        text = F.replace(text, F.lit(mark), values[slot])
    return text
