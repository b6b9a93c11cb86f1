"""Change detection, upserts and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums


def snapshot_diff(before: DataFrame, now: DataFrame, *, same_version: bool = True) -> DataFrame:
    """(path, change): added, changed or removed between manifests (path, mtime, sha256).

    With another version or signature every present path counts as changed.
    """
    b = before.select("path", F.col("mtime").alias("m0"), F.col("sha256").alias("s0"), F.lit(True).alias("was"))
    joined = b.join(now.withColumn("present", F.lit(True)), "path", "full_outer")
    same = F.col("m0").eqNullSafe(F.col("mtime")) & F.col("s0").eqNullSafe(F.col("sha256"))
    change = F.when(F.col("present").isNull(), "removed").when(F.lit(not same_version), "changed").when(F.col("was").isNull(), "added").when(~same, "changed")
    return joined.select("path", change.alias("change")).where("change IS NOT NULL")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key the last row by the order columns."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def attach(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Set columns of rows that exist; values of unknown keys are dropped."""
    return rows.join(values, key)


def attached_count(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """One row: how many given values found their row, and how many did not."""
    known = rows.select(key).distinct().withColumn("hit", F.lit(1))
    told = values.select(key).join(known, key, "left")
    return told.agg(F.count("hit").alias("updated"), F.count(F.when(F.col("hit").isNull(), 1)).alias("unmatched"))


def unprocessed(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def progress_totals(done: DataFrame, expected: int, price_in: float = 0.00025, price_out: float = 0.00075) -> DataFrame:
    """One row: processed, tokens, percent (null if nothing is expected) and cost of a log with a column tokens."""
    return done.agg(F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens")).select(
        "processed", "tokens", F.round(F.try_divide(F.lit(100) * F.col("processed"), F.lit(expected)), 6).alias("percent"),
        F.round(F.col("tokens") / 1000 * (price_in + price_out), 6).alias("cost"),
    )


def progress_eta(log: DataFrame, expected: int) -> DataFrame:
    """One row of a log with a timestamp `at`: processed, seconds since the first entry, seconds for each, seconds left."""
    t = log.agg(F.count(F.lit(1)).alias("processed"), (F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))).alias("elapsed"))
    each = F.try_divide(F.col("elapsed"), F.col("processed"))
    return t.select("processed", "elapsed", F.round(each, 6).alias("average"), F.round(F.coalesce(each * (F.lit(expected) - F.col("processed")), F.lit(0.0)), 6).alias("remaining"))


def progress_running(log: DataFrame, expected: int, price_in: float = 0.00025, price_out: float = 0.00075) -> DataFrame:
    """A log (at, id, tokens) with what had been done at each entry, in order of time and id: processed, running_tokens, cost, elapsed
    seconds, seconds left. Entries without a time come first and have no elapsed time."""
    r = running_sums(log.select("at", "id", "tokens"), [F.asc_nulls_first("at"), F.asc("id")], {"processed": F.lit(1).cast("long"), "running_tokens": F.coalesce("tokens", F.lit(0)).cast("long")})
    first = log.agg(F.min("at").alias("began"))
    elapsed = F.unix_timestamp("at") - F.unix_timestamp("began")
    left = F.col("elapsed") / F.col("processed") * (F.lit(expected) - F.col("processed"))
    told = r.crossJoin(F.broadcast(first)).withColumn("elapsed", elapsed)  # one row
    return told.select("id", "processed", "running_tokens", F.round(F.col("running_tokens") / 1000 * (price_in + price_out), 6).alias("cost"), "elapsed", F.round(left, 3).alias("remaining"))
