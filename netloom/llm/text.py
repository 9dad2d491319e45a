"""Column expressions on whole texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and the characters counted as symbols.
GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, out of the way of other names."""
    return F.struct(*(col(c).alias(c) for c in df.columns))


def as_text(*names: str) -> list[Column]:
    """Longs on their way into pandas, where a null beside them would make them
    doubles, which hold no more than 53 bits."""
    return [col(n).cast("long").cast("string").alias(n) for n in names]


def as_longs(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns that as_text() made back as longs."""
    return df.withColumns({n: col(n).cast("long") for n in names})


def columns_of(row: str, names: list[str]) -> list[Column]:
    """The columns that whole_row() put into the struct ``row``."""
    return [F.col(row)[c].alias(c) for c in names]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_of(text: Column, chars: str) -> Column:
    """How many of ``chars`` a text holds; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.length(t) - F.length(F.translate(t, chars, ""))
