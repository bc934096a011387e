"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it is expected to be taken. Among all rates between 0 and a cap that
meet the token targets of the sources, those nearest to one in relative entropy are exponentially tilted:
``rate = min(cap, exp(multiplier(source) * size / scale(source)))``. The multipliers solve a convex dual, here by
Newton steps: each step is one Spark aggregation over the sizes, the driver holds a few numbers for each source.
Rates are then rounded to whole copies by running totals, so that rounding errors cancel within a source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlens.session import materialize

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Sources are few beside documents; their totals are held by the driver up to this number.
MAX_SOURCES = 100_000
STEPS, TOLERANCE = 60, 1e-7
#: Fixed-point unit of sums and rates: whole numbers add up to the same total in any order.
UNIT = 10 ** 9
#: Running totals are cut into pieces: size classes (eighths of an octave) and, within one, this many hash parts.
PARTS = 16


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> list[float]:
    """Target of each source: its weight's part of ``share`` of all sizes, at most ``cap`` times its size.

    What is cut off is shared by weight among the sources below their limit until none is above.
    """
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weigh[i] for i in free)
        over = sorted(i for i in free if left * weigh[i] > cap * sizes[i] * total)
        if not over:
            for i in free:
                out[i] = left * weigh[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            free.discard(i)
        left = share * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def sized(df: DataFrame, keep: Sequence[str], source_col: str, text_col: str) -> DataFrame:
    """The ``keep`` columns, ``source`` and ``size`` in words (0 for a null text)."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", -1), "")
    return df.select(*keep, F.col(source_col).alias("source"), F.size(words).cast("long").alias("size"))


def _table(spark, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small table of source numbers (``id``) and values."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def solve(docs: DataFrame, sources: Sequence[dict]) -> list[float]:
    """Multiplier of each source by safeguarded Newton steps on the dual; infinity where every rate is the cap.

    ``docs`` has (``id`` of the source, ``size``, ``n`` documents of that size). A step that leaves the interval known
    to hold the solution is replaced by its middle, so that the search ends for any sizes.
    """
    low, high, at = [-60.0] * len(sources), [60.0] * len(sources), [0.0] * len(sources)
    fixed = {i for i, s in enumerate(sources) if s["target"] >= CAP * s["total"] or s["total"] == 0}
    best, wanted = dict.fromkeys(fixed, math.inf), [i for i in range(len(sources)) if i not in fixed]
    for _ in range(STEPS):
        if not wanted:
            break
        now = F.broadcast(_table(docs.sparkSession, [(i, at[i], float(sources[i]["scale"])) for i in wanted],
                                 ["id", "multiplier", "scale"]))
        tilt = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("scale"), F.lit(50.0)))
        exact = lambda c: F.sum(F.round(c * 1e6).cast("decimal(38,0)")).cast("double") / 1e6
        sums = docs.join(now, "id").groupBy("id").agg(
            exact(F.col("n") * F.col("size") * F.least(tilt, F.lit(float(CAP)))).alias("words"),
            exact(F.when(tilt < CAP, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * tilt).otherwise(0.0)).alias("slope"))
        left = []
        for r in sums.collect():
            i = r["id"]
            gap = r["words"] - sources[i]["target"]
            best[i] = at[i]
            if abs(gap) <= TOLERANCE * sources[i]["target"] or high[i] - low[i] < 1e-12:
                continue
            low[i], high[i] = (low[i], at[i]) if gap > 0 else (at[i], high[i])
            step = at[i] - gap / r["slope"] if r["slope"] > 0 else math.inf
            at[i] = step if low[i] < step < high[i] else (low[i] + high[i]) / 2
            left.append(i)
        wanted = sorted(left)
    return [best[i] for i in range(len(sources))]


def mix(df: DataFrame, keep: Sequence[str] = ("doc_id",), source_col: str = "source", text_col: str = "text",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The ``keep`` columns, ``source``, ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` of every row.

    Sources are numbered by code point with null last. Rows are ordered by size, then by the hash of the ``keep``
    columns, so reruns agree; rows that are equal in everything are interchangeable. Texts without words have size 0
    and are never taken; a source without words has target 0; an empty table gives no rows. Names of ``keep`` must
    differ from the other columns; put clashing ones into a struct.
    """
    spark = df.sparkSession
    rows = materialize(sized(df, keep, source_col, text_col), "mix_sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("total"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError("more sources than the driver holds totals for")
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sources = [{"name": r["source"], "total": r["total"], "scale": max(r["total"] / max(r["n"], 1), 1.0), "target": t}
               for r, t in zip(found, targets([r["total"] for r in found], weights, share))]
    if not sources:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("source_size", "long"), ("target", "double"),
                                                             ("rate", "double"), ("copies", "int"))]
        return rows.select(*keep, "source", "size", *nothing)
    names = F.broadcast(_table(spark, [(i, s["name"], s["total"], s["target"]) for i, s in enumerate(sources)],
                               ["id", "name", "source_size", "target"]).withColumn("name", F.col("name").cast("string")))
    numbered = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    counted = materialize(numbered.groupBy("id", "size").agg(F.count("*").alias("n")), "mix_counts")
    multiplier = solve(counted, sources)
    tilts = F.broadcast(_table(spark, [(i, m if math.isfinite(m) else 1e9, s["scale"]) for i, (m, s) in
                                       enumerate(zip(multiplier, sources))], ["id", "multiplier", "scale"]))
    tilt = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("scale"), F.lit(50.0)))
    rated = numbered.join(tilts, "id").withColumn("rate", F.when(F.col("size") > 0, F.least(tilt, F.lit(float(CAP)))).otherwise(0.0))
    order = F.xxhash64(*keep)
    placed = rated.select(*keep, "source", "size", "source_size", "target", "rate", "id",
                          F.round(F.col("rate") * UNIT).cast("long").alias("units"), order.alias("order"),
                          F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")) * 8)).otherwise(-1).cast("int").alias("class"),
                          F.pmod(order, F.lit(PARTS)).cast("int").alias("part"))
    pieces = placed.groupBy("id", "class", "part").agg(F.sum("units").alias("units"))
    earlier = Window.partitionBy("id").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("id", "class", "part", F.coalesce(F.sum("units").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("id", "class", "part").orderBy("size", "order", *keep).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("upto", F.sum("units").over(inside)).join(offsets, ["id", "class", "part"])
    whole = lambda c: F.floor((c + F.lit(UNIT // 2)) / F.lit(UNIT)).cast("int")
    end = F.col("offset") + F.col("upto")
    return run.select(*keep, "source", "size", "source_size", "target", "rate",
                      (whole(end) - whole(end - F.col("units"))).alias("copies"))
