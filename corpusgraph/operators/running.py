"""Running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import work

#: The bits of Spark's increasing ids that number rows inside a partition.
_BITS = 33


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], *, path: str | None = None) -> DataFrame:
    """The rows with a column for each of `sums`: its sum from the first row in order up to this one.

    Rows are sorted by ranges and stored with their places. Each range sums its own rows; what came before a range is the
    sum of the ranges before it, a row for each range, which the driver adds up and sends out. Rows that tie in the order
    stay in one range, so the order should tell rows apart. A null counts as nothing. Sums of integers and decimals are
    exact; sums of doubles depend on the ranges in their last digits.
    """
    spark = rows.sparkSession
    if set(sums) & set(rows.columns):
        raise ValueError(f"columns exist already: {sorted(set(sums) & set(rows.columns))}")
    told = rows.select("*", *(c.alias(n) for n, c in sums.items())).orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    kept = work.stored(told, f"{path or work.shared_dir(spark)}/ranges").withColumn("_range", F.shiftright("_place", _BITS))
    totals = kept.groupBy("_range").agg(*(F.sum(n).alias(n) for n in sums))
    kinds = {f.name: f.dataType for f in totals.schema.fields}
    before, so_far = [], [None] * len(sums)
    for r in sorted(totals.collect(), key=lambda r: r["_range"]):
        before.append((r["_range"], *so_far))
        so_far = [a if b is None else b if a is None else a + b for a, b in zip(so_far, r[1:], strict=True)]
    schema = "_range long" + "".join(f", _before_{n} {kinds[n].simpleString()}" for n in sums)
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = kept.withColumns({n: F.sum(n).over(inside) for n in sums}).join(F.broadcast(spark.createDataFrame(before, schema)), "_range")
    return summed.select(*rows.columns, *((F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums))
