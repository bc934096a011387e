"""Content hashes of a folder and the list that declares them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.sources.files import read_folder

#: Lines that travel together.
LINES_BYTES = 1 << 20


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file below ``root``, without names that start with a dot and the hash list itself.

    Files are hashed in pieces, so their size does not matter.
    """
    return read_folder(spark, root, hashed=True).where((F.col("path") != C.HASH_LIST) & ~F.col("path").rlike(r"(^|/)\."))


def hash_lines(hashes: DataFrame) -> DataFrame:
    return hashes.select("path", F.concat("sha256", F.lit("  "), "path", F.lit("\n")).alias("line"))


def tree_hash(hashes: DataFrame) -> DataFrame:
    """One row: the hash of all hash lines in path order.

    A hash of one stream has to be worked out in one place. The lines are sorted by ranges and strung together in pieces of
    about ``LINES_BYTES`` in parallel; one task then reads the pieces in order, one batch at a time, and keeps nothing but the state of the hash.
    """
    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = None, bytearray()
        for batch in batches:
            for path, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = path if first is None else first
                held += line.encode()
                if len(held) >= LINES_BYTES:
                    yield pa.RecordBatch.from_pydict({"first": [first], "lines": [bytes(held)]})
                    first, held = None, bytearray()
        if held:
            yield pa.RecordBatch.from_pydict({"first": [first], "lines": [bytes(held)]})

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            for lines in batch.column(0):
                digest.update(lines.as_buffer())
        yield pa.RecordBatch.from_pydict({"tree_sha256": [digest.hexdigest()]})

    lines = hash_lines(hashes).repartitionByRange("path").sortWithinPartitions("path")
    pieces = lines.mapInArrow(strung, "first string, lines binary")
    # A first piece without lines: a folder without files has a hash too.
    pieces = pieces.unionByName(hashes.sparkSession.range(1).select(F.lit(None).cast("string").alias("first"), F.lit(b"").alias("lines")))
    return pieces.repartition(1).sortWithinPartitions("first").select("lines").mapInArrow(digested, "tree_sha256 string")


def declared_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) from a hash list with lines ``sha256``, two spaces, path."""
    pattern = r"^(\S+)  (.*)$"
    return (spark.read.text(path).where(F.col("value").rlike(r"\S"))
            .select(F.regexp_extract("value", pattern, 2).alias("path"),
                    F.regexp_extract("value", pattern, 1).alias("sha256")))


def table_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of the rows of a table that does not depend on their order.

    A row's hash is 60 bits of the MD5 of its cells in the order of the column names, each with its length, so that
    neither moved separators nor nulls look alike; the hashes are added up. Cells of structs and arrays are hashed as their JSON text.
    """
    def cell(name: str, kind: str) -> Column:
        text = F.to_json(F.struct(F.col(f"`{name}`"))) if kind.startswith(("struct", "array", "map")) else F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[cell(c, t) for c, t in sorted(df.dtypes)])), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("table_hash"), F.count("*").alias("rows"))
