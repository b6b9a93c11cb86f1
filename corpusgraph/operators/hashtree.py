"""Snapshots of files as hash trees: a diff looks only below folders that differ.

A folder's hash stands for all files below it: two 64-bit sums, by exclusive or, of hashes of path, time and content, and their number. Such
sums are made in each task, so a folder of any size is never gathered. Folders are stored by level, files by parts of their
folder's hash. A diff compares the root, then level by level the folders below those that differ, then the files in them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import work
from . import incremental

PARTS = 64


@dataclass(frozen=True)
class Tree:
    """folders (level, folder, parent, h1, h2, n) and files (path, folder, mtime, sha256, part), both as stored; levels below the root."""

    folders: DataFrame
    files: DataFrame
    levels: int


def _folder(path: Column) -> Column:
    """The part of a path before its last slash; empty for files at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def build(files: DataFrame, path: str | None = None, *, parts: int = PARTS) -> Tree:
    """Store the tree of files (path, mtime, sha256); paths are unique and not null."""
    spark = files.sparkSession
    root = path or work.shared_dir(spark)
    f = files.select("path", "mtime", "sha256").withColumn("folder", _folder(F.col("path"))).withColumn("part", F.pmod(F.xxhash64("folder"), F.lit(parts)).cast("int"))
    f.write.mode("overwrite").partitionBy("part").parquet(f"{root}/files")
    kept = spark.read.schema(f.schema).parquet(f"{root}/files")
    names = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(names, 1, i), "/").alias("folder"), F.array_join(F.slice(names, 1, F.greatest(i - 1, F.lit(0))), "/").alias("parent")))
    each = kept.select(F.xxhash64("path", "mtime", "sha256").alias("a"), F.xxhash64(F.lit("second"), "sha256", "mtime", "path").alias("b"), F.explode(above).alias("x"))
    folders = each.groupBy("x.level", "x.folder", "x.parent").agg(F.bit_xor("a").alias("h1"), F.bit_xor("b").alias("h2"), F.count(F.lit(1)).alias("n"))
    folders.write.mode("overwrite").partitionBy("level").parquet(f"{root}/folders")
    stored = spark.read.schema(folders.schema).parquet(f"{root}/folders")
    return Tree(stored, kept, stored.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])


def open_tree(spark: SparkSession, path: str) -> Tree:
    """A tree that build has stored."""
    folders, files = spark.read.parquet(f"{path}/folders"), spark.read.parquet(f"{path}/files")
    return Tree(folders, files, folders.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])


def unequal_folders(before: Tree, now: Tree, *, path: str | None = None) -> DataFrame:
    """(level, folder) of the folders that differ, or are in one tree only. Each level is compared below the unequal folders of the one above, which
    are stored; the walk ends where there are none."""
    root = path or work.shared_dir(now.files.sparkSession)
    found, above = [], None
    for level in range(max(before.levels, now.levels) + 1):
        sides = []
        for tree in (before, now):
            f = tree.folders.where(F.col("level") == level).select("folder", "parent", "h1", "h2", "n")
            sides.append(f if above is None else f.join(above.select(F.col("folder").alias("parent")), "parent", "left_semi"))
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("h1", "h2", "n")]
        both = sides[0].alias("b").join(sides[1].alias("n"), F.col("b.folder") == F.col("n.folder"), "full_outer")
        differ = both.where(~(same[0] & same[1] & same[2])).select(F.lit(level).alias("level"), F.coalesce("b.folder", "n.folder").alias("folder"))
        above = work.stored(differ, f"{root}/level{level}")
        if above.isEmpty():
            break
        found.append(above)
    out = found[0] if found else above
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def diff(before: Tree, now: Tree, *, path: str | None = None) -> DataFrame:
    """(path, change): added, changed or removed, as incremental.snapshot_diff gives it. Only files in unequal folders are compared, only their parts read."""
    return incremental.snapshot_diff(*compared(before, now, path=path))


def compared(before: Tree, now: Tree, *, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The files of both trees that a diff compares: those in folders that differ."""
    folders = unequal_folders(before, now, path=path).select("folder").distinct()
    parts = [r[0] for r in folders.select(F.pmod(F.xxhash64("folder"), F.lit(PARTS)).cast("int").alias("part")).distinct().collect()]  # PARTS at most
    below = lambda t: t.files.where(F.col("part").isin(*parts) if parts else F.lit(False)).join(folders, "folder", "left_semi").select("path", "mtime", "sha256")
    return below(before), below(now)
