"""Scalar expressions of the effect estimates: bins, transforms, decisions and number formats."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftlens import constants as C


def ctr_bin(position: Column) -> Column:
    """Index of the left-closed position bin, clipped to the first and last bin."""
    reached = reduce(add, [(position >= edge).cast("int") for edge in C.CTR_EDGES])
    return F.greatest(F.lit(0), reached - 1)


def effect_transform(log_ratio: Column, metric: Column) -> Column:
    """Share by which a metric went up, or by which the position number went down."""
    change = F.expm1(log_ratio)
    return F.when(metric == "position", -change).otherwise(change)


def decide(low: Column, high: Column, threshold: Column) -> Column:
    return (F.when(low >= threshold, C.SUPPORTED)
            .when(high < threshold, C.REJECTED)
            .otherwise(C.UNDECIDED))


def percent(value: Column) -> Column:
    """Signed percentage with one decimal; a dash when there is no value."""
    return F.when(value.isNotNull(), F.format_string("%+.1f %%", value * 100)).otherwise(C.NO_PERCENT)


def general_number(value: Column) -> Column:
    """Shortest form with six significant digits, for magnitudes from 1e-4 up to 1e6."""
    size = F.abs(value)
    text = F.format_string("%.9f", value)
    for decimals in range(9, -1, -1):
        text = F.when(size >= 10.0 ** (5 - decimals), F.format_string(f"%.{decimals}f", value)).otherwise(text)
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
