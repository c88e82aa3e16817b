"""Rounding and tolerance rules, null-safe, as column expressions.

Three distance rules and two course rules exist side by side; each has a name
here, so that a comparison says which one it uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCE_SIMPLE_NM = 0.1
DISTANCE_GRAPH_NM, DISTANCE_GRAPH_SHARE = 0.2, 0.02
COURSE_DEG = 1.0


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half goes up, towards +infinity, judged on the binary value: floor(x * 10^digits + 0.5) / 10^digits."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def blank(x: Column) -> Column:
    """Text for comparison: trimmed, upper case, null as empty."""
    return F.upper(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def same_text(a: Column, b: Column) -> Column:
    return blank(a) == blank(b)


def same_number(a: Column, b: Column) -> Column:
    """Both missing is equal, one missing is not."""
    return a.eqNullSafe(b)


def distance_simple(a: Column, b: Column, within: float = DISTANCE_SIMPLE_NM) -> Column:
    return F.coalesce(F.abs(a - b) <= within, a.isNull() & b.isNull())


def distance_graph(a: Column, b: Column, within: float = DISTANCE_GRAPH_NM, share: float = DISTANCE_GRAPH_SHARE) -> Column:
    """Close by value or by share of the larger."""
    apart = F.abs(a - b)
    return F.coalesce((apart <= within) | (apart <= share * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def distance_eval(expected: Column, actual: Column, within: float = DISTANCE_SIMPLE_NM) -> Column:
    return F.coalesce(F.abs(expected - actual) <= within, F.lit(False))


def course_apart(a: Column, b: Column) -> Column:
    """Degrees between two courses, the short way round."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def course_circular(a: Column, b: Column, within: float = COURSE_DEG) -> Column:
    return F.coalesce(course_apart(a, b) <= within, a.isNull() & b.isNull())


def course_linear(expected: Column, actual: Column, within: float = COURSE_DEG) -> Column:
    """Without going round, as evaluation does it."""
    return F.coalesce(F.abs(expected - actual) <= within, F.lit(False))


def altitude_text(kind: Column, lower: Column, upper: Column) -> Column:
    """One text of an altitude constraint; nulls stay empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws(":", part(kind), part(lower), part(upper))
