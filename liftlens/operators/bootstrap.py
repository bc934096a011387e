"""Page-level cluster bootstrap of the effects, with percentile intervals.

The n draws of a repetition are first split over blocks of pages (a multinomial, drawn as a tree of binomials) and only then
made inside each block, where its pages lie together. So a repetition sends one row for each block and never one for each page.
Every random bit is a hash of (seed, hypothesis, model, tag, role, repetition, place in the tree), so the result depends neither
on partitioning nor on the number of executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.functions.stats import effect_transform
from liftlens.functions.binding import let, record
from liftlens.operators.predictions import arm_difference
from liftlens.operators.ranking import spread_rank
from liftlens.params import Params
from liftlens.session import materialize

#: Pages that lie together in one row; their draws are made there.
BLOCK_SLOTS = 64
#: Random bits of one hash, and places of a probability's binary expansion. Trials that are still undecided after all
#: places (one of 2^60) count as failures.
HASH_BITS, PLACES = 60, 60


def hash_bits(text: Column) -> Column:
    """60 random bits as a number."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def heads(trials: Column, text: Column) -> Column:
    """Number of heads in so many fair throws: set bits of hashes, a whole hash at a time."""
    def thrown(total: Column, at: Column) -> Column:
        bits = hash_bits(F.concat_ws("|", text, at.cast("string")))
        used = F.least(F.lit(HASH_BITS), trials - at * HASH_BITS).cast("int")
        return total + F.bit_count(F.call_function("shiftright", bits, HASH_BITS - used))

    return F.when(trials <= 0, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", trials - 1, F.lit(HASH_BITS).cast("bigint"))),
                    F.lit(0), thrown)).cast("bigint")


def binomial(trials: Column, part: Column, whole: Column, text: Column) -> Column:
    """Exact draw from Binomial(trials, part / whole).

    Each trial compares a random binary fraction with the probability place by place. A trial is decided at the first place
    where they differ, a success if the probability has the one, so half of the open trials end at each place.
    """
    long = lambda c: F.lit(c).cast("bigint")

    def place(state: Column, at: Column) -> Column:
        def decided(ones: Column) -> Column:
            one = state["rest"] * 2 >= whole
            return record(open=F.when(one, ones).otherwise(state["open"] - ones),
                          won=F.when(one, state["won"] + state["open"] - ones).otherwise(state["won"]),
                          rest=state["rest"] * 2 - F.when(one, whole).otherwise(long(0)))
        return F.when(state["open"] <= 0, state).otherwise(
            let(heads(state["open"], F.concat_ws("|", text, at.cast("string"))), decided))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PLACES)), record(open=trials, won=long(0), rest=part), place, lambda s: s["won"])


def stream(p: Params, tag: str, role: Column) -> Column:
    """Name of the random stream of a (hypothesis, model, role, repetition)."""
    return F.concat_ws("|", F.lit(str(p.seed)), F.col("hypothesis_id"), F.col("model"), F.lit(tag), role, F.col("rep").cast("string"))


def draw_tasks(spark: SparkSession) -> int:
    """Tasks that make draws. Their input is a few bytes for each hundred hashes, so they are numbered and not cut by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def split_draws(sizes: DataFrame, p: Params, tag: str, role: Column, block: int, levels: int) -> DataFrame:
    """(``rep``, ``block``, ``size``, ``drawn``): how many of the n draws of each repetition fall into each block of slots.

    ``sizes`` has a row with ``n`` for each sample. A range of blocks is halved level by level and its draws with it; blocks
    without draws end there.
    """
    keys = sizes.columns
    size, last = F.lit(block).cast("bigint"), p.bootstrap_reps - 1
    at = (sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(last))))
          .repartition(draw_tasks(sizes.sparkSession), *[k for k in keys if k != "n"], "rep")
          .select(*keys, "rep", F.lit(0).cast("bigint").alias("low"), F.ceil(F.col("n") / size).alias("high"),
                  F.col("n").alias("drawn")))
    for _ in range(levels):
        low, high, drawn = F.col("low"), F.col("high"), F.col("drawn")
        middle = low + F.call_function("div", high - low + 1, F.lit(2).cast("bigint"))
        whole = F.least(high * size, F.col("n")) - low * size
        left = binomial(drawn, (middle - low) * size, whole, F.concat_ws("|", stream(p, tag, role), low.cast("string"), high.cast("string")))
        halves = let(left, lambda k: F.array(record(low=low, high=middle, drawn=k), record(low=middle, high=high, drawn=drawn - k)))
        same = F.array(record(low=low, high=high, drawn=drawn))
        at = (at.select(*keys, "rep", F.inline(F.when(high - low > 1, halves).otherwise(same))).where("drawn > 0"))
    return at.select(*keys, "rep", F.col("low").alias("block"), F.least(size, F.col("n") - F.col("low") * size).alias("size"), "drawn")


def resampled(ranked: DataFrame, pairs: DataFrame, groups: Sequence[str], value: Column, p: Params, tag: str, role: Column,
              block: int) -> DataFrame:
    """``value`` of every drawn slot, with the groups, ``model`` and ``rep``.

    Draws are rows only between the blocks they come from and the grouping that follows, which combines them before its shuffle.
    """
    most = ranked.agg(F.max("n")).first()[0] or 0
    levels = (-(-most // block) - 1).bit_length() if most else 0
    sizes = ranked.where("slot = 0").select(*groups, F.col("n").cast("bigint").alias("n")).join(F.broadcast(pairs), ["hypothesis_id", "metric"])
    counts = split_draws(sizes, p, tag, role, block, levels)
    blocks = (ranked.groupBy(*groups, F.expr(f"slot div {block}L").alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("slot", value.alias("value")))).alias("slots")))
    drawn = (counts.repartition(draw_tasks(ranked.sparkSession), *groups, "block").join(blocks, [*groups, "block"])
             .withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("drawn")))))
    inside = hash_bits(F.concat_ws("|", stream(p, tag, role), F.col("block").cast("string"), F.lit("in"), F.col("draw").cast("string"))) % F.col("size")
    return drawn.select(*groups, "model", "rep", F.get(F.col("slots"), inside.cast("int"))["value"].alias("value"))


def control_pages(changes: DataFrame) -> DataFrame:
    """Control pages with a change in every cohort, each with its short list of changes."""
    controls = changes.where(F.col("role") == "control")
    cohorts = (controls.groupBy("hypothesis_id", "metric", "arm", "window_key").agg(F.count("*").alias("pages"))
               .groupBy("hypothesis_id", "metric").agg(F.count("*").alias("cohorts")))
    return (controls.groupBy("hypothesis_id", "metric", "page")
            .agg(F.collect_list(F.struct("arm", "window_key", "delta")).alias("cells"))
            .join(F.broadcast(cohorts), ["hypothesis_id", "metric"])
            .where(F.size("cells") == F.col("cohorts"))
            .drop("cohorts"))


def draws(changes: DataFrame, usable: DataFrame, p: Params, tag: str = "") -> DataFrame:
    """Resampled effect per hypothesis, model and repetition, for the few (hypothesis, model, kind,
    metric) rows of ``usable``.

    Control pages are resampled once per repetition and shared by all arms and cohorts. Treated rows
    are resampled per arm. The numbered pages are stored, as several steps read them. Both sides are averaged per cohort
    before they meet, so nothing of size pages x pages is built.
    """
    pairs = usable.select("hypothesis_id", "model", "metric")

    ranked = materialize(spread_rank(control_pages(changes), ["hypothesis_id", "metric"], ["page"]), "control_slots")
    control_means = (resampled(ranked, pairs.where(F.col("model") != "naive_prepost"), ["hypothesis_id", "metric"], F.col("cells"), p,
                               tag, F.lit("control"), BLOCK_SLOTS)
                     .select("hypothesis_id", "model", "rep", F.inline("value"))
                     .groupBy("hypothesis_id", "model", "rep", "arm", "window_key")
                     .agg(F.avg("delta").alias("control_mean")))

    rows = changes.where(F.col("role") == "treated").select("hypothesis_id", "metric", "arm", "page", "window_key", "delta")
    treated = materialize(spread_rank(rows, ["hypothesis_id", "metric", "arm"], ["page", "window_key"]), "treated_slots")
    sums = (resampled(treated, pairs, ["hypothesis_id", "metric", "arm"], F.struct("window_key", "delta"), p, tag, F.col("arm"), BLOCK_SLOTS)
            .groupBy("hypothesis_id", "model", "metric", "rep", "arm", F.col("value.window_key").alias("window_key"))
            .agg(F.sum("value.delta").alias("total"), F.count("*").alias("rows")))
    change = F.when(F.col("model") == "naive_prepost", F.col("total")).otherwise(
        F.col("total") - F.col("rows") * F.col("control_mean"))
    per_arm = (sums.join(control_means, ["hypothesis_id", "model", "rep", "arm", "window_key"], "left")
               .groupBy("hypothesis_id", "model", "metric", "rep", "arm")
               .agg((F.sum(change) / F.sum("rows")).alias("mean_diff"))
               .join(F.broadcast(usable.select("hypothesis_id", "model", "kind")), ["hypothesis_id", "model"])
               .withColumn("effect", effect_transform(F.col("mean_diff"), F.col("metric"))))
    return arm_difference(per_arm, ["hypothesis_id", "model", "rep"], "effect", "draw")


def intervals(drawn: DataFrame, p: Params) -> DataFrame:
    """Exact percentile interval at the plain and at the corrected level; a group holds one value
    per repetition."""
    tail, tail_adj = (1 - p.ci_level) / 2, (1 - p.ci_level_adj) / 2
    points = F.percentile("draw", F.array(*[F.lit(q) for q in (tail, 1 - tail, tail_adj, 1 - tail_adj)]))
    names = ["ci_low", "ci_high", "ci_low_adj", "ci_high_adj"]
    return (drawn.groupBy("hypothesis_id", "model").agg(points.alias("q"))
            .select("hypothesis_id", "model", *[F.col("q")[i].alias(name) for i, name in enumerate(names)]))
