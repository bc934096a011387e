"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, lookup: DataFrame, on: Sequence[str], spread: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi join of ``big`` with a ``lookup`` that is unique on ``on``.

    Rows of one key go to ``salts`` partitions by the hash of their ``spread`` columns, and every
    lookup row is present in each of them, so a hot key is split and no row is lost or repeated.
    """
    salted = big.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "salt"], how).drop("salt")
