"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _large(e: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of the neighbourhood."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. Edges have u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    pulled = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pulled.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, path: str) -> DataFrame:
    """(u, v): for each node but the smallest of its component, that smallest node.

    edges: columns u, v (long). Every round is written below `path`, so its lineage is short and survives lost
    executors. The rounds end when one changes nothing; their number grows with the logarithm of the size.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before, turn = stored(now, f"{path}/0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now
        before, turn = state, turn + 1
        now = stored(_small(_large(now).distinct()).distinct(), f"{path}/{turn}")
        if turn > 1:
            forget(edges.sparkSession, f"{path}/{turn - 2}")
