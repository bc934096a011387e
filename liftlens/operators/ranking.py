"""Distributed dense numbering of the rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def spread_rank(df: DataFrame, groups: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Add ``slot`` (0..n-1 within the group) and ``n`` without ranking a whole group in one task.

    Rows are ordered by a hash bucket of their identity and then by the identity. Each bucket is
    numbered on its own and shifted by the sizes of the buckets before it: at most 16^3 sizes per
    group, which is the only thing brought together. The result does not depend on partitioning.
    """
    groups, identity = list(groups), list(identity)
    bucketed = df.withColumn("bucket", F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity])),
                                                   1, BUCKET_DIGITS))
    sizes = bucketed.groupBy(*groups, "bucket").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "bucket",
                           F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"),
                           F.sum("size").over(Window.partitionBy(*groups)).alias("n"))
    inside = Window.partitionBy(*groups, "bucket").orderBy(*identity)
    return (bucketed.withColumn("row", F.row_number().over(inside))
            .join(F.broadcast(offsets), [*groups, "bucket"])
            .withColumn("slot", F.col("offset") + F.col("row") - 1)
            .drop("bucket", "row", "offset"))
