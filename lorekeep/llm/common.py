"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import release, stored

__all__ = ["LOWER", "SPACES", "SPACE_RUN", "UPPER", "ascii_lower", "free", "release", "stored", "widened", "without"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of characters other than space, tab, newline, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def without(df: DataFrame, *taken: str) -> DataFrame:
    """Drops columns whose names an operator is about to add (compared without case)."""
    low = {t.lower() for t in taken}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def widened(schema: StructType, more: str) -> StructType:
    """schema and the columns of a DDL string after it (StructType.add would change the frame's own schema)."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def free(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that no column of df has (compared without case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem in taken:
            stem += "_"
        taken.add(stem)
        found.append(stem)
    return found
