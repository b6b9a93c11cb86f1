"""Exact quantiles of few, huge groups by selection in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import work

#: Ranges that a step cuts a span of values into.
RANGES = 1024


def quantiles(rows: DataFrame, group: str, value: str, at: tuple[float, ...], *, path: str | None = None) -> DataFrame:
    """(group, q, value): of each group the quantiles at `at`, between two neighbouring values by share, as SQL's quantile_cont.

    Each rank that is wanted has a span of values that holds it, at first all. A step counts the rows of the span's RANGES ranges, with their
    least and greatest values, and keeps the one that holds the rank; a span of one value is the answer. Counts are summed
    in each task, so no task holds a group or sorts it, however its values repeat. Rows are read once for each step, six at most or so. Null
    values do not count; a group without values has none. A null group is a group. NaN is greater than all.
    """
    root = path or work.shared_dir(rows.sparkSession)
    v = work.stored(rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), f"{root}/values")
    span = v.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.col("q") * (F.col("n") - 1)
    wanted = span.select("g", "n", "lo", "hi", F.explode(F.array(*map(F.lit, at))).alias("q")).withColumn("place", place)
    ranks = wanted.select("g", "lo", "hi", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    state, step = work.stored(ranks.withColumn("below", F.lit(0).cast("long")), f"{root}/step0"), 0
    while not state.where("lo <> hi").isEmpty():
        step += 1
        s = state.where("lo <> hi").withColumnRenamed("g", "sg")
        inside = v.join(s, F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("lo"), F.col("hi")))
        # Halves first: the difference of two large values of unlike signs has no room in a double.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("v") == F.col("hi"), RANGES).otherwise(F.least(F.lit(RANGES - 1), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * RANGES)))
        counts = inside.groupBy("sg", "rank", "below", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("sg", "rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("upto", F.col("below") + upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        next_ = found.select(F.col("sg").alias("g"), "lo", "hi", "rank", (F.col("upto") - F.col("n")).alias("below"))
        state = work.stored(state.where("lo = hi").unionByName(next_), f"{root}/step{step}")
    at_rank = lambda name, to: state.select(F.col("g").alias(f"g_{to}"), F.col("rank").alias(f"r_{to}"), F.col("lo").alias(to))
    told = wanted.join(at_rank("floor", "low"), F.col("g").eqNullSafe(F.col("g_low")) & (F.floor("place") == F.col("r_low")))
    told = told.join(at_rank("ceil", "high"), F.col("g").eqNullSafe(F.col("g_high")) & (F.ceil("place") == F.col("r_high")))
    between = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    return told.select(F.col("g").alias(group), "q", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value"))
