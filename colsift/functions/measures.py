"""Percentages, severity bands and sort ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def half_even_sql(value: str, places: int) -> str:
    """Round a non-negative double as its exact binary value, ties to even.

    ``bround`` rounds the shortest decimal text of a double instead, which
    takes 0.015 (binary slightly below) for a tie. Twice the scaled value is
    split into a double and its exact rounding error to see on which side of
    the middle it lies. ``value`` is SQL; one expression text keeps the number
    of calls into the JVM low.
    """
    unit = f"{10 ** places}D"
    twice = f"{2 * 10 ** places}D"
    low = f"double(floor({value} * {unit}))"
    head = f"({value} * 134217729D - ({value} * 134217729D - {value}))"
    product = f"({value} * {twice})"
    error = f"(({head} * {twice} - {product}) + ({value} - {head}) * {twice})"
    side = f"(({product} - ({low} * 2 + 1)) + {error})"
    return f"(({low} + IF({side} > 0 OR ({side} = 0 AND {low} % 2 = 1), 1D, 0D)) / {unit})"


def pct_sql(part: str, whole: str) -> str:
    return half_even_sql(f"IF({whole} = 0, 0D, {part} / {whole} * 100D)", 2)


def pct(part: str, whole: str) -> Column:
    """``part`` in percent of ``whole``, rounded to 2 places; 0 for an empty whole.

    Both are names of columns, or SQL."""
    return F.expr(pct_sql(part, whole))


def py_pct(part: int, whole: int) -> float:
    """The same percentage for facts already on the driver."""
    return round(part / whole * 100.0, 2) if whole else 0.0


def four_bands(count: Column, percent: Column, bands) -> Column:
    """PASS without a hit, else LOW to CRITICAL.

    The count decides about PASS: a share that rounds to 0.00 is still LOW.
    """
    low, medium, high = bands
    return (F.when(count == 0, "PASS")
            .when(percent <= low, "LOW")
            .when(percent <= medium, "MEDIUM")
            .when(percent <= high, "HIGH")
            .otherwise("CRITICAL"))


def three_bands(percent: Column, bands) -> Column:
    low, medium = bands
    return (F.when(percent <= low, "LOW")
            .when(percent <= medium, "MEDIUM")
            .otherwise("HIGH"))


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL up to 4 for PASS."""
    rank = F.when(severity == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], 1):
        rank = rank.when(severity == name, i)
    return rank.otherwise(4)


def priority_level(severity: Column) -> Column:
    return F.concat(F.lit("P"), severity_rank(severity).cast("string"))


def clamp_score(value: str) -> Column:
    """SQL ``value`` kept within 0..100 and rounded to 2 places."""
    return F.expr(half_even_sql(f"greatest(0D, least(100D, {value}))", 2))


def preview(value: Column) -> Column:
    """Text of at most 100 characters; longer text keeps 97 and an ellipsis."""
    return F.when(F.char_length(value) > 100, F.concat(F.substring(value, 1, 97), F.lit("..."))
                  ).otherwise(value)
