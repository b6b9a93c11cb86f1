"""Sharding through fixed virtual slots (DataFrame and SQL functions only).

Records hash into `slots` virtual slots, whose number never changes. Bytes are summed per slot, and a
versioned slot-to-shard map decides the shard: version 1 deals slots out in turn, each later version is an
edit of the one before. A run with a map of its own (`map_path`) reads the newest version there, and appends an edited one only if slots
have to move. `rebalance` leaves a slot where it is as long as its shard stays within the mean load
and moves the others to the least loaded shard, largest first; `grow` moves slots only into the new shard.
Only slot statistics (one row per slot, a fixed number) ever meet in one task; records are never gathered.

Defined results: a null text has no bytes and the checksum of empty text; a null id hashes like any value;
repeated rows stay together in one virtual slot and get successive positions; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

SLOTS = 8192
OVERHEAD = 8


def records(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): what sharding needs of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) for every slot, empty ones too; summed before the shuffle."""
    seen = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(seen, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slot i belongs to shard i mod shards."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def rebalance(slot_map: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, edited so that the shards hold nearly equal bytes."""
    rows = slot_map.join(stats, "virtual_slot").agg(
        F.max("version").alias("version"),
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard", "bytes"))).alias("items"),
        F.ceil(F.sum("bytes") / shards).alias("mean"),
    )
    chosen = f"""
        aggregate(items,
          struct(array_repeat(0L, {shards}) AS loads, cast(array() AS array<int>) AS out),
          (acc, x) -> transform(array(
              if(x.shard < {shards} AND acc.loads[x.shard] + x.bytes <= mean, x.shard,
                 cast(array_position(acc.loads, array_min(acc.loads)) - 1 AS int))),
            t -> struct(transform(acc.loads, (v, i) -> if(i = t, v + x.bytes, v)) AS loads,
                        concat(acc.out, array(t)) AS out))[0],
          acc -> acc.out)"""
    return (
        rows.where("size(items) > 0")
        .select("version", "items", F.expr(chosen).alias("out"))
        .select((F.col("version") + 1).alias("version"), F.explode(F.arrays_zip("items", "out")).alias("x"))
        .select("version", F.col("x.items.virtual_slot").alias("virtual_slot"), F.col("x.out").alias("shard"))
    )


def grow(slot_map: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard: of each old shard the first slots, in hash order, that make up
    its share 1/(shards+1) of the bytes move to the new shard; nothing moves between old shards."""
    order = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot")
    whole = Window.partitionBy("shard")
    return (
        slot_map.join(stats, "virtual_slot")
        .withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all", F.sum("bytes").over(whole))
        .select(
            (F.col("version") + 1).alias("version"), "virtual_slot",
            F.when(F.col("upto") * (shards + 1) <= F.col("all"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
        )
    )


def place(recs: DataFrame, slot_map: DataFrame, stats: DataFrame) -> DataFrame:
    """Each record's shard and its gapless position in that shard.

    A position is the number of records in the shard's earlier virtual slots plus the rank inside the own one, so
    only a virtual slot (1/8192 of the records) is ordered in one task. The joined map has one row per slot.
    """
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(stats, "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start")
    )
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return recs.withColumn("rank", rank).join(F.broadcast(starts), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
        "virtual_slot", F.col("version").alias("map_version"),
    )


def shard(docs: DataFrame, *, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text",
          map_path: str | None = None) -> DataFrame:
    """Shard a table by bytes: statistics, the newest map with the edit that they ask for, placement by it.

    map_path: the folder of a map that lives on; without it versions 1 and 2 are made in a new folder. A map of more shards than
    `shards` gives up those beyond, one of fewer fills the new ones by moving slots there.
    """
    spark = docs.sparkSession
    root = map_path or shared_dir(spark)
    recs = records(docs, id_col=id_col, text_col=text_col, slots=slots)
    stats = stored(slot_bytes(recs, slots).coalesce(1), f"{root}/slot_bytes")
    return place(recs, newest_map(spark, root, stats, shards, slots), stats)


def newest_map(spark: SparkSession, root: str, stats: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The newest map stored below `root`, after the edit that the statistics ask for; that edit is appended as a version of its own.

    The map's rows, one a slot in each version, are appended and never changed, so every version can be read.
    """
    at = f"{root.rstrip('/')}/slot_map"
    if not _exists(spark, at):
        first = initial_map(spark, shards, slots)
        versions = stored(first.unionByName(rebalance(first, stats, shards)).coalesce(1), at)
        return versions.where(F.col("version") == 2)
    kept = spark.read.parquet(at)
    if kept.select("virtual_slot").distinct().count() != slots:
        raise ValueError(f"the map at {at} has another number of slots than {slots}")
    last = kept.agg(F.max("version")).first()[0]
    now = kept.where(F.col("version") == last)
    edit = rebalance(now, stats, shards)
    was = now.select("virtual_slot", F.col("shard").alias("was"))
    if edit.join(was, "virtual_slot").where("shard <> was").isEmpty():
        return now
    edit.select(*kept.columns).coalesce(1).write.mode("append").parquet(at)
    return spark.read.schema(kept.schema).parquet(at).where(F.col("version") == last + 1)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
