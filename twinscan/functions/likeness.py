"""Likeness formulas as Column expressions: they stay in whole-stage code generation, without Python."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def property_name_likeness(a: Column, b: Column) -> Column:
    """1 for equal names, 0.95 for names equal but for case and outer blanks, else an edit ratio.

    The ratio divides by the longer name's UTF-8 bytes while the distance counts characters.
    """
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    longest = F.greatest(F.octet_length(x), F.octet_length(y))
    ratio = F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / longest)
    return F.when(a == b, 1.0).when(x == y, 0.95).otherwise(ratio)


def name_likeness(a: Column, b: Column) -> Column:
    """Case-sensitive edit ratio over characters; two empty names are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column, empty: float = 0.5) -> Column:
    """Jaccard index of two arrays as sets; ``empty`` if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def base_likeness(distance: Column, n1: Column, n2: Column) -> Column:
    """1 - distance over the larger size, not below 0; 1 for two empty trees."""
    most = F.greatest(n1, n2)
    return F.when(most == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - distance / most))


def edit_likeness(distance: Column, n1: Column, n2: Column, size_penalty: bool = True) -> Column:
    """Tree-edit likeness from a distance and both sizes, with the penalties for small and uneven trees."""
    d, n1, n2 = (_lit(c).cast("double") for c in (distance, n1, n2))
    most, least = F.greatest(n1, n2), F.least(n1, n2)
    part = F.when(most > 0, d / most).otherwise(0.0)
    ratio = F.when(most > 0, least / most).otherwise(1.0)
    gap = most - least
    s = base_likeness(d, n1, n2)
    # Reached only with edit costs under one per node: no distance although the sizes differ.
    free = (d == 0) & (gap > 0)
    s = F.when(free & (gap > 10), s * 0.5).when(free & ((ratio < 0.95) | (gap > 3)), s * F.sqrt(ratio)).otherwise(s)
    if not size_penalty:
        return s

    def soft(floor: float, slope: float) -> Column:
        return floor + (1 - floor) * clamp(1 - slope * part, 0.0, 1.0)

    changed = d > 0
    small_pair = F.when(changed & (most < 8), 0.55).when(changed & (most < 16), soft(0.92, 8)).otherwise(1.0)
    small_side = (
        F.when(changed & (least < 10), F.greatest(F.lit(0.25), F.pow(least / 10, F.lit(0.7))) * F.when(part > 0.04, 0.6).otherwise(1.0))
        .when(changed & (least < 20), soft(0.92, 4) * F.when(part > 0.18, 0.85).otherwise(1.0))
        .when(changed & (least < 30), soft(0.95, 4) * F.when(part > 0.13, 0.88).otherwise(1.0))
        .when(~changed & (least < 8), clamp((least + 4) / 12, 0.7, 0.95))
        .otherwise(1.0)
    )
    far = F.when(part > 0.16, F.greatest(F.lit(0.3), 1 - 4 * (part - 0.16))).otherwise(1.0)
    uneven = F.when(ratio < 0.5, F.sqrt(ratio)).otherwise(1.0)
    return s * small_pair * small_side * far * uneven


def short_function_factor(score: Column, lines1: Column, lines2: Column) -> Column:
    """The score, lowered for functions of under ten lines on average unless it is high."""
    mean = (lines1 + lines2) / 2.0
    base = F.greatest(F.lit(0.1), mean / 10)
    trust = clamp((score - 0.6) / 0.32, 0.0, 1.0)
    return F.when(mean < 10, score * (base + (1 - base) * trust)).otherwise(score)


def atom_cap(score: Column, control_differs: Column, missing1: Column, missing2: Column) -> Column:
    """The score, capped where two functions use different operations; the first that applies.

    A difference in control flow caps at 0.72; operations missing on both sides cap at 0.75 less 0.03 for
    each beyond two, not below 0.55; four or more missing on one side only cap at 0.85. Scores up to 0.6 stay.
    """
    total = missing1 + missing2
    both = F.greatest(F.lit(0.55), 0.75 - 0.03 * (total - 2))
    cap = F.when(control_differs, 0.72).when((missing1 > 0) & (missing2 > 0), both).when(total >= 4, 0.85)
    return F.when((score > 0.6) & cap.isNotNull(), F.least(score, cap)).otherwise(score)


def line_count(start: Column, end: Column) -> Column:
    return end - start + 1


def impact(lines1: Column, lines2: Column) -> Column:
    """Lines that would go if the smaller twin were removed."""
    return F.least(lines1, lines2)


def type_structure(quality_sum: Column, matched: Column, p1: Column, p2: Column, names: Column) -> Column:
    """Structural likeness of two types: mean match quality times coverage.

    Two types without properties get 0.6 + 0.4 of their names' likeness, one without gets 0.
    """
    return F.when((p1 == 0) & (p2 == 0), 0.6 + 0.4 * names).when((p1 == 0) | (p2 == 0) | (matched == 0), 0.0).otherwise(quality_sum / matched * (2 * matched / (p1 + p2)))


def type_naming(name_sum: Column, matched: Column, names: Column) -> Column:
    """Naming likeness of two types: 0.8 of the matched properties' mean, 0.2 of the type names'."""
    return F.when(matched == 0, names).otherwise(0.8 * name_sum / matched + 0.2 * names)


def weighted(structure: Column, naming: Column) -> Column:
    return 0.85 * structure + 0.15 * naming


def scalar(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A scalar likeness of two texts (``type_text``) as a function of columns, in Arrow batches; null if either is null.

    Made for distinct pairs: score those, then join the scores back.
    """

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(f(x, y)) for x, y in zip(a, b)], dtype="float64")

    return of
