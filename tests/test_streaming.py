from datetime import date

from conftest import frame, settings
from test_estimates import K1

from liftlens.operators.panel import page_day
from liftlens.streaming.panel import final_page_day

DDL = "date date, page string, segment string, clicks long, impressions long, position double"


def test_days_are_emitted_once_when_final(spark, tmp_path):
    def add(name, *rows):
        frame(spark, list(rows), DDL).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    early = [(date(2026, 1, d), "A", s, 1, 10, 2.0) for d in (1, 2) for s in ("local", "general")]
    add("a", *early)
    stream = spark.readStream.schema(DDL).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run():
        (final_page_day(stream, settings(K1, analysis_cutoff=date(2026, 9, 10))).writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
         .start(str(tmp_path / "out")).awaitTermination())
        return {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()

    assert run() == set()
    add("b", (date(2026, 1, 6), "A", "local", 1, 10, 2.0))
    run()
    add("c", (date(2026, 1, 1), "A", "local", 500, 500, 1.0), (date(2026, 1, 7), "A", "local", 1, 10, 2.0))
    columns = ["date", "page", "clicks", "impressions", "position"]
    final = {tuple(r) for r in page_day(frame(spark, early, DDL)).select(columns).collect()}
    assert run() == final
