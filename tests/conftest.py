import sys
from dataclasses import dataclass
from datetime import date, timedelta
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("liftlens-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def frame(spark, rows, ddl):
    """A small DataFrame from Python rows, without Python workers."""
    schema = StructType.fromDDL(ddl)
    table = pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table)


TURN = date(2025, 3, 10)
OPENING, CLOSING = date(2024, 12, 1), date(2025, 6, 30)


@dataclass(frozen=True)
class Plot:
    """A page of a test site: its group, daily values until the turn and from it on, and when it was changed."""

    group: str
    early: dict
    late: dict
    turned: date | None = None
    ends: date = CLOSING


def settings(*hypotheses, **changes):
    """Short windows: pre 2025-02-07 to 03-07, post 2025-03-17 to 04-14 for a change at the turn."""
    from liftlens import Params
    short = dict(pre_days=28, buffer_days=3, ramp_days=7, post_days=28, min_post_days=20, min_days_per_window=14,
                 placebo_shift_days=40, bootstrap_reps=150, analysis_cutoff=CLOSING + timedelta(3))
    return Params(hypotheses=hypotheses, **{**short, **changes})


def garden(spark, chosen, plots, changes=(), segment="general"):
    """The study of a site of ``plots`` (by page id); the daily rows are unfolded by Spark. ``changes`` come on top."""
    from liftlens.plans.study import Study
    usual = {"clicks": 80.0, "impressions": 2000.0, "position": 4.0}
    beds = [(page, plot.group, plot.ends, *[{**usual, **values}[c] for values in (plot.early, plot.late) for c in usual])
            for page, plot in plots.items()]
    wide = frame(spark, beds, "page string, design_group string, ends date, " + ", ".join(
        f"{c}_{half} double" for half in ("early", "late") for c in usual))
    daily = wide.select("*", F.explode(F.sequence(F.lit(OPENING), F.col("ends"))).alias("date")).select(
        "date", "page", F.lit(segment).alias("segment"),
        *[F.when(F.col("date") < TURN, F.col(f"{c}_early")).otherwise(F.col(f"{c}_late")).alias(c) for c in usual])
    log = [(page, plot.group, plot.turned) for page, plot in plots.items() if plot.turned] + list(changes)
    interventions = frame(spark, [(f"C{n:02d}", *entry, "") for n, entry in enumerate(log)],
                          "intervention_id string, page string, type string, date date, description string")
    pages = wide.select("page", F.concat(F.lit("https://garden.example/"), "page").alias("url"), "design_group")
    authority = frame(spark, [], "date date, metric string, source string, value double")
    return Study(spark, pages, daily, interventions, authority, chosen)
