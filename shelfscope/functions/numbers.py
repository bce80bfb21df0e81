"""Rounding and ratio rules: halves go up, divisions by zero are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds to `digits` places; a half goes towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in per cent to one place, 0 if whole is 0."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def fixed(x: Column, digits: int) -> Column:
    """x as text with `digits` decimals."""
    return F.format_string(f"%.{digits}f", x)


def clamp_int(value: object, fallback: int, low: int, high: int) -> int:
    """A whole number from user input; below `low` or unreadable gives the fallback, above `high` that."""
    try:
        n = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return fallback
    if n != n or n in (float("inf"), float("-inf")):
        return fallback
    n = int(n + 0.5) if n >= 0 else -int(-n + 0.5)
    return fallback if n < low else min(n, high)


def clamp(value: object, fallback: int, low: int, high: int) -> int:
    """Like clamp_int, but values below `low` become `low`."""
    try:
        n = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return fallback
    return fallback if n != n else max(low, min(high, int(n + 0.5)))


def string_hash(s: Column) -> Column:
    """A positive number from a string: the 31-times hash over its characters in 32 bits."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))
    return F.when(total >= 2147483648, F.lit(4294967296) - total).otherwise(total)
