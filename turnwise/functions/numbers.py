"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, decimals: int) -> Column:
    """Round the binary value of a double, ties to even, as Python's ``round`` does.

    ``round`` and ``bround`` work on the shortest decimal form and differ where that form is a tie and the binary
    value is not. ``format_number`` rounds the binary value."""
    return F.replace(F.format_number(x, decimals), F.lit(","), F.lit("")).cast("double")


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda total, x: total + x * x))
