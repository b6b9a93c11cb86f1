"""Refresh of an element table as files arrive and change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ELEMENTS
from ..sources import elements as caches
from ..sources import parse

#: Up to so many paths of a batch are looked up by name; beyond, the whole tree is compared.
PATHS = 1000


def follow(spark: SparkSession, root: str, cache: str, notices: str, checkpoint: str, *, parser: str = "tree-sitter", project: str = "", explain=None):
    """A stream writer that keeps the versioned cache of the Python files below `root` up to date. Start it with `.start()`.

    Spark's file source never reads a path twice, so it is not the files that stream but notices of change: JSON lines with a `path`
    relative to root (edited, added or removed) or without one (anything may have changed). Each batch looks at the files as
    they are then, and commits elements, failures and removals as one version; by their hashes a batch that is run again after a
    restart finds its work done.
    """

    def put(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().limit(PATHS + 1).collect()]
        if paths:
            caches.analyse(spark, root, cache, parser=parser, project=project, explain=explain, only=None if None in paths or len(paths) > PATHS else paths)

    told = spark.readStream.schema("path string").json(notices)
    return told.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def watch(spark: SparkSession, root: str, elements: str, checkpoint: str, *, parser: str = "tree-sitter", project: str = ""):
    """A stream writer of the Python files that come below `root`, each read once (for edits and removals see `follow`). A batch's elements
    are appended to the table at `elements`, its failures (file_path, error) to the one at `elements`-errors, in folders by
    batch, so a batch that is run again replaces what it wrote. Paths are relative to root, as in a scan. Start it with `.start()`."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(root)
    rows = files.select(caches.below(root, F.col("path")).alias("file_path"), F.decode("content", "UTF-8").alias("source"), F.unix_millis("modificationTime").alias("updated_at"))

    def put(batch: DataFrame, number: int) -> None:
        made = parse.parse_files(batch.select("file_path", "source"), parser, project).persist()
        good = made.where("error IS NULL").drop("error").join(batch.select("file_path", "updated_at"), "file_path")
        good.select(*ELEMENTS.names, "updated_at").write.mode("overwrite").parquet(f"{elements}/batch={number}")
        made.where("error IS NOT NULL").select("file_path", "error").write.mode("overwrite").parquet(f"{elements.rstrip('/')}-errors/batch={number}")
        made.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
