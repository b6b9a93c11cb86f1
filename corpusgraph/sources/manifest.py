"""Snapshots of files and the manifest they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..schemas import MANIFEST
from . import versions

VERSION = 1


def embed_signature(dimension: int, metric: str = "cosine") -> str:
    return f"{dimension}:{metric}"


@dataclass(frozen=True)
class Manifest:
    """File rows (path, mtime, sha256), the version of the schema and the signature of the embeddings."""

    files: DataFrame
    version: int = VERSION
    signature: str = ""


def snapshot(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """(path, mtime in seconds, sha256) of all files below a folder; the manifest's own folder and progress files do not count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    own = F.col("path").rlike(r"/(manifest|progress)/|/(\.\w*manifest|progress)\.json$")
    return files.where(~own).select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def read(spark: SparkSession, path: str) -> Manifest:
    """The last manifest stored whole; an empty one of the present version where there is none."""
    commits, _ = versions.history(spark, path)
    if not commits:
        return Manifest(spark.createDataFrame([], MANIFEST))
    told = commits[-1].body
    return Manifest(spark.read.schema(MANIFEST).parquet(f"{path}/{told['files']}"), told["version"], told["signature"])


def write(spark: SparkSession, path: str, m: Manifest) -> None:
    """Rows go to a new folder, then a commit file of the next number names it: a write that breaks leaves the former manifest."""
    number = versions.history(spark, path)[1] + 1
    files = f"files-{versions.new_batch(number)}"
    m.files.select(*MANIFEST.names).write.parquet(f"{path}/{files}")
    versions.put(spark, path, number, {"version": m.version, "signature": m.signature, "files": files, "fresh": True})


def diff(before: Manifest, now: Manifest) -> DataFrame:
    """(path, change); another version or signature changes every path."""
    return incremental.snapshot_diff(before.files, now.files, same_version=(before.version, before.signature) == (now.version, now.signature))


def merged(before: DataFrame, changes: DataFrame, rebuild: Callable[[DataFrame], DataFrame], path: str = "path") -> DataFrame:
    """Rows of unchanged paths as they were, rows of added and changed paths built anew, rows of removed paths gone."""
    touched = changes.select(F.col("path").alias(path))
    return before.join(touched, path, "left_anti").unionByName(rebuild(changes.where("change <> 'removed'").select(F.col("path").alias(path))))


@dataclass(frozen=True)
class BuildResult:
    mode: str  # cold, refresh or unchanged
    changed: int
    removed: int
    version: int


def build(spark: SparkSession, root: str, at: str, index: Callable[[DataFrame, DataFrame], None], *, signature: str = "", force: bool = False) -> BuildResult:
    """Bring an index up to date with the files below `root`.

    index: called with the paths to build and the paths to drop, if there are any. The manifest is written after it.
    """
    before = read(spark, at)
    now = Manifest(snapshot(spark, root).persist(), VERSION, signature)
    try:
        cold = force or not before.files.head(1)
        changes = diff(Manifest(spark.createDataFrame([], MANIFEST)) if cold else before, Manifest(now.files, VERSION, "") if cold else now).persist()
        n = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        if n:
            index(changes.where("change <> 'removed'").select("path"), changes.where("change = 'removed'").select("path"))
            write(spark, at, now)
        changes.unpersist()
    finally:
        now.files.unpersist()
    return BuildResult("cold" if cold else "refresh" if n else "unchanged", n.get("added", 0) + n.get("changed", 0), n.get("removed", 0), VERSION)
