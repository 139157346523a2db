"""Column expressions that bring the tables' differently spelled values into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_mode(c: Column) -> Column:
    """Lower case, without blanks and tabs around it; an empty mode is null."""
    m = F.lower(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))
    return F.when(m != "", m)


def norm_path(c: Column) -> Column:
    """Slashes instead of backslashes and no leading ``./``; null stays null."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def valid_score(c: Column) -> Column:
    """The score where it is a number in 0..1, else null."""
    return F.when(~F.isnan(c) & c.between(0.0, 1.0), c)
