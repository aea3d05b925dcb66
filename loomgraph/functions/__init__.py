"""Column functions of the graph engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What text output shows for an unreachable vertex: the largest finite single-precision number.
UNREACHABLE = 3.4028234663852886e38
UNREACHABLE_TEXT = "340282346638528859811704183484516925440.000000"


def owner(vertex: Column, parts: int) -> Column:
    """Number of the partition that owns a vertex."""
    return F.pmod(vertex, F.lit(parts)).cast("int")


def changed(old: Column, new: Column, tolerance: float) -> Column:
    """Whether a value moved by more than the tolerance; a value that appears or goes has moved."""
    return F.when(old.isNull() | new.isNull(), old.isNull() != new.isNull()).otherwise(F.abs(new - old) > tolerance)


def deviation(old: Column, new: Column) -> Column:
    """How far a value moved; 0 if it is null before or after."""
    return F.coalesce(F.abs(new - old), F.lit(0.0))


def path_text(source: int, vertex: Column, distance: Column) -> Column:
    """``path_len(source, vertex):distance`` with the sentinel for unreachable vertices."""
    shown = F.when(distance.isNull(), F.lit(UNREACHABLE_TEXT)).otherwise(F.format_string("%.6f", distance))
    return F.concat(F.format_string(f"path_len({source}, %d):", vertex), shown)


def common_above(a: Column, b: Column, floor: Column) -> Column:
    """Number of pairs of equal entries above ``floor`` in two lists; repeated entries count with their product."""
    return F.aggregate(
        F.filter(a, lambda x: x > floor),
        F.lit(0).cast("long"),
        lambda n, x: n + F.size(F.filter(b, lambda y: y == x)),
    )
