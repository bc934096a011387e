"""Raw snapshots and derived tables on storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens import constants as C
from liftlens.sources.files import read_bodies

# Columns whose empty cells are empty text; other empty cells are missing values.
TEXT_COLUMNS = ["page", "url", "design_group", "segment", "date", "intervention_id", "type", "description",
                "snapshot", "metric", "source", "file", "content_type"]


def read_raw_table(spark: SparkSession, path: str, splittable: bool = False) -> DataFrame:
    """A CSV table with every column as text under its header name; nothing is inferred.

    Quoted cells may hold line breaks, so a file is read whole; the daily panel, which has none, is ``splittable``.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", not splittable).csv(path)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in TEXT_COLUMNS else F.col(c)
                        for c in raw.columns])


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot folder by file name; a file that is absent has no entry."""
    tables = {}
    for name in C.SNAPSHOT_FILES:
        try:
            tables[name] = read_raw_table(spark, f"{path}/{name}", name == "gsc_daily.csv")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return tables


def typed_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Study tables with their types; a cell that is not empty and has no value of its type is an error.

    Whole numbers may be written with decimals, as in ``10.0``.
    """
    def value(c, kind):
        typed = F.col(c).try_cast("decimal(38,9)").try_cast(kind) if kind in ("int", "bigint") else F.col(c).try_cast(kind)
        lost = typed.isNull() & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
        return F.when(lost, F.raise_error(F.concat(F.lit(f"{c} is no {kind}: "), F.col(c).cast("string"))).cast(kind)).otherwise(typed)

    def cast(name, **types):
        return raw[name].select(*[value(c, types[c]).alias(c) if c in types else F.col(c) for c in C.SNAPSHOT_FILES[name]])

    scores = {m: "int" for m in C.SCORES}
    return {
        "pages": cast("pages.csv"),
        "gsc_daily": cast("gsc_daily.csv", date="date", clicks="bigint", impressions="bigint", position="double"),
        "interventions": cast("interventions.csv", date="date"),
        "lighthouse": cast("lighthouse.csv", date="date", **scores, lcp_ms="int", cls="double", inp_ms="int"),
        "authority": cast("authority.csv", date="date", value="double"),
    }


def read_crawl(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A crawl folder: the index with the body files it names; no body is empty text.

    A body is found by its path below the folder, whatever its name. A named file that is absent gives empty text here
    and a finding in the validation. ``seq`` keeps the order of the index, in which the last status of a repeated url counts.
    """
    index = (read_raw_table(spark, f"{path}/index.csv")
             .withColumn("seq", F.monotonically_increasing_id()))
    found = read_bodies(index, path, ["url", "status", "content_type", "seq"])
    return found.select(F.lit(label).alias("label"), "url", F.col("status").cast("int").alias("status"), "content_type",
                        F.coalesce(F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n"), F.lit("")).alias("html"), "seq")


def write_table(df: DataFrame, path: str, monthly: bool = False) -> None:
    """Store a derived table; daily panels can be split by month so date filters skip folders."""
    if monthly:
        df.withColumn("month", F.trunc("date", "month")).write.mode("overwrite").partitionBy("month").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
