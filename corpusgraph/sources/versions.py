"""Versions of a table keyed by path, each made whole by one commit file.

A writer stores its rows and a log of the paths it touched under a batch name that nothing reads yet, then creates the commit file
of the next number, never over one that is there. Readers take whole commit files only, so a run that breaks at any step
leaves the version before it. A path's last logged state decides: its rows are those of the batch that parsed it last, and it has
none once it has failed or is removed. Rows, states and what a manifest or checkpoint needs so become visible together.

Creation is exclusive where the file system's is (HDFS, stores with conditional writes); of two writers with the same number one fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "path string, sha256 string, state string, error string, at timestamp, batch string"
#: Where a batch's name stands in the path of its files.
BATCH = r"/(\d{12}-[0-9a-f]{32})/"


class Conflict(Exception):
    """Another writer has made the version."""


@dataclass(frozen=True)
class Commit:
    number: int
    body: dict


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, root: str, number: int, body: dict) -> Commit:
    """Create commit file `number`; Conflict if there is one."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/commits/{number:012d}.json")
    if fs.exists(p):
        raise Conflict(f"version {number} of {root} exists")
    try:
        out = fs.create(p, False)
    except Exception as e:  # lost the race
        if fs.exists(p):
            raise Conflict(f"version {number} of {root} exists") from e
        raise
    try:
        out.write(json.dumps(body | {"end": True}).encode())
    finally:
        out.close()
    return Commit(number, body)


def history(spark: SparkSession, root: str) -> tuple[list[Commit], int]:
    """The whole commits since the last fresh one, oldest first, and the highest number in use, by a broken one too."""
    fs, folder = _fs(spark, f"{root.rstrip('/')}/commits")
    if not fs.exists(folder):
        return [], 0
    found, top, utils = [], 0, spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    for f in sorted(fs.listStatus(folder), key=lambda f: f.getPath().getName()):
        name = f.getPath().getName()
        if not name.endswith(".json"):
            continue
        top = max(top, int(name[:-5]))
        stream = fs.open(f.getPath())
        try:
            body = json.loads(utils.toString(stream, "UTF-8"))
        except ValueError:
            continue
        finally:
            stream.close()
        if isinstance(body, dict) and body.pop("end", False):
            found = [] if body.get("fresh") else found
            found.append(Commit(int(name[:-5]), body))
    return found, top


def new_batch(number: int) -> str:
    """A name that sorts by number and is never used twice."""
    return f"{number:012d}-{uuid.uuid4().hex}"


def states(spark: SparkSession, root: str, commits: list[Commit]) -> DataFrame:
    """The last logged row of each path, of removed ones too."""
    if not commits:
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).parquet(*(f"{root.rstrip('/')}/log/{c.body['batch']}" for c in commits))
    names = [f.split()[0] for f in LOG.split(", ")]
    return log.groupBy("path").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("s.*")


def changes(files: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of present files (path, sha256) those that the table does not hold as they are, failed ones again; and the paths that it holds
    but that are gone."""
    done = before.where("state = 'done'").select("path", "sha256")
    todo = files.join(done, ["path", "sha256"], "left_anti")
    gone = before.where("state <> 'removed'").select("path").join(files.select("path"), "path", "left_anti")
    return todo, gone


def log_rows(batch: str, todo: DataFrame, failed: DataFrame, gone: DataFrame) -> DataFrame:
    """The log of a batch: done or failed (path, error) for what it parsed, removed for what is gone."""
    told = todo.select("path", "sha256").join(failed.groupBy("path").agg(F.min("error").alias("error")), "path", "left")
    rows = told.select("path", "sha256", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), "error")
    none = F.lit(None).cast("string")
    every = rows.unionByName(gone.select("path", none.alias("sha256"), F.lit("removed").alias("state"), none.alias("error")))
    return every.withColumns({"at": F.current_timestamp(), "batch": F.lit(batch)})


def commit(spark: SparkSession, root: str, batch: str, log: DataFrame, number: int, **body) -> Commit:
    """Store the log of a batch whose rows are stored, then make it version `number`."""
    log.write.parquet(f"{root.rstrip('/')}/log/{batch}")
    return put(spark, root, number, {"batch": batch} | body)


def live(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Of rows (path, batch, ...) those of each path's last batch, if that is done."""
    return rows.join(now.where("state = 'done'").select("path", "batch"), ["path", "batch"], "left_semi")


def refresh(spark: SparkSession, root: str, files: DataFrame, build) -> Commit | None:
    """Bring the table at `root` up to date with files (path, sha256, ...): one commit, or none if nothing changed.

    build: makes rows (path, error, ...) of changed files; a path with an error has no other rows that count.
    """
    commits, top = history(spark, root)
    todo, gone = changes(files, states(spark, root, commits))
    batch, at = new_batch(top + 1), root.rstrip("/")
    if todo.isEmpty() and gone.isEmpty():
        return None
    build(todo).withColumn("batch", F.lit(batch)).write.parquet(f"{at}/rows/{batch}")
    failed = spark.read.parquet(f"{at}/rows/{batch}").where("error IS NOT NULL").select("path", "error")
    return commit(spark, root, batch, log_rows(batch, todo, failed, gone), top + 1, rows=f"rows/{batch}")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of the last whole version, or of one before it that is still in the history."""
    commits = [c for c in history(spark, root)[0] if version is None or c.number <= version]
    if not commits:
        raise ValueError(f"no version {'' if version is None else version} at {root}")
    rows = spark.read.parquet(*(f"{root.rstrip('/')}/{c.body['rows']}" for c in commits))
    return live(rows, states(spark, root, commits)).where("error IS NULL").drop("error")


def errors(spark: SparkSession, root: str) -> DataFrame:
    """(path, error, at) of the files that fail in the last version."""
    return states(spark, root, history(spark, root)[0]).where("state = 'failed'").select("path", "error", "at")


def compact(spark: SparkSession, root: str) -> Commit | None:
    """Write what counts anew as one batch, so that readers need no older commit. Older versions are no longer readable."""
    commits, top = history(spark, root)
    if not commits:
        return None
    at, batch, now = root.rstrip("/"), new_batch(top + 1), states(spark, root, commits).where("state <> 'removed'")
    rows = spark.read.parquet(*(f"{at}/{c.body['rows']}" for c in commits))
    live(rows, now).withColumn("batch", F.lit(batch)).write.parquet(f"{at}/rows/{batch}")
    return commit(spark, root, batch, now.withColumn("batch", F.lit(batch)), top + 1, rows=f"rows/{batch}", fresh=True)
