"""Source trees and element caches: scan, parse, store, read again, checkpoint.

Folders are read by Spark, so any store it knows will do. A cache holds `results_<parser>/` with elements as JSON lines, a folder for
each run, and a log of versions (see versions.py): one row for each file a run has touched, by path and hash, so an edited or failed
file is parsed again and a removed one goes. `read_cache` gives all that was ever stored, `read_current` what counts now.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ELEMENTS, PROGRESS
from . import parse, versions

CORRUPT = "_corrupt"


def below(root: str, path: Column) -> Column:
    """A file's path relative to a folder."""
    top = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), F.lit(top), F.lit(""))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, source, sha256) of all Python files below a folder; paths are relative to it."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
    return files.select(below(root, F.col("_metadata.file_path")).alias("file_path"), F.col("value").alias("source"), F.sha2("value", 256).alias("sha256"))


def decode(rows: DataFrame, column: str = "json") -> DataFrame:
    """Elements of JSON texts (column `json`, and file_path of the row for those that lack one), with json_path and an `error` for texts that
    are no element. A stored id is ignored: ids follow from type, name and path. Missing lists are empty; a list given as null stays null."""
    kinds = T.StructType([*(f for f in ELEMENTS.fields if f.name != "id"), T.StructField(CORRUPT, T.StringType())])
    e = F.from_json(column, kinds, {"columnNameOfCorruptRecord": CORRUPT})
    known = F.array(*(F.lit(f.name) for f in ELEMENTS.fields))
    keys = F.json_object_keys(column)
    lists = [f.name for f in ELEMENTS.fields if isinstance(f.dataType, T.ArrayType)]
    bad = F.when(e.isNull() | e[CORRUPT].isNotNull() | keys.isNull(), "not a JSON object of the schema")
    bad = bad.when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(F.array_except(keys, known)), ", ")))
    bad = bad.when(e["name"].isNull() | e["type"].isNull(), "no name or type")
    got = rows.select(F.col("file_path").alias("_path"), e.alias("e"), keys.alias("k"), bad.alias("error"))
    absent = lambda f: F.when(~F.array_contains("k", f.name), F.array().cast(f.dataType)).otherwise(F.col(f"e.{f.name}"))
    value = lambda f: absent(f) if f.name in lists else F.coalesce("e.file_path", "_path") if f.name == "file_path" else F.col(f"e.{f.name}")
    out = got.select("error", "_path", *(F.when(F.col("error").isNull(), value(f)).alias(f.name) for f in ELEMENTS.fields if f.name != "id"))
    key = parse.X.element_id(F.col("type"), F.col("name"), F.col("file_path"))
    ok = F.col("error").isNull()
    return out.select(F.when(ok, key).alias("id"), *(c for c in ELEMENTS.names if c != "id"), F.col("_path").alias("json_path"), "error")


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """All elements of a cache, of former runs too, with their `error`: JSON files in folders named results_*, manifests and progress files left out.

    Files that Spark wrote hold an object a line, others one object each."""
    path = F.col("_metadata.file_path")
    mine = path.rlike(r"/results_[^/]*/") & ~path.rlike(r"/(\.\w*manifest|progress)\.json$")
    told = lambda df: df.where(mine).select(path.alias("file_path"), F.col("value").alias("json")).where(F.length(F.trim("json")) > 0)
    lines = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter="part-*.json")
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").where(~path.rlike(r"/part-[^/]*$"))
    return decode(told(lines).unionByName(told(whole)))


def write_cache(elements: DataFrame, root: str, parser: str = "tree-sitter", *, mode: str = "append") -> str:
    """Elements as JSON lines below results_<parser>; nulls are written, so that nothing is taken for missing."""
    path = f"{root.rstrip('/')}/results_{parser}"
    elements.select(*ELEMENTS.names).write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The elements of the last whole version: of each file those of the run that parsed it last, none of failed and removed files."""
    commits, _ = versions.history(spark, root)
    if not commits:
        return spark.createDataFrame([], ELEMENTS)
    lines = spark.read.text([f"{root.rstrip('/')}/{c.body['rows']}" for c in commits], pathGlobFilter="part-*.json")
    told = decode(lines.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("json"))).where("error IS NULL")
    rows = told.withColumns({"path": F.col("file_path"), "batch": F.regexp_extract("json_path", versions.BATCH, 1)})
    return versions.live(rows, versions.states(spark, root, commits)).select(*ELEMENTS.names)


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """The checkpoint's rows (kind, key, sha256, state, at), the last of each file; none before the first run."""
    now = versions.states(spark, root, versions.history(spark, root)[0])
    return now.select(F.lit("file").alias("kind"), F.col("path").alias("key"), "sha256", "state", "at").select(*PROGRESS.names)


def analyse(spark: SparkSession, root: str, cache: str, *, parser: str = "tree-sitter", project: str = "", explain=None, only: list[str] | None = None) -> dict[str, int]:
    """Parse the files below `root` that the cache does not hold in their present form, and store their elements as one version.

    explain: a function over elements that sets explanations, if wanted. only: look at these paths alone. Returns how many files
    were new, failed, and how many elements they gave. Elements and log are visible once the commit is there: a run that
    breaks off leaves the version before it, and the next run parses the same files again.
    """
    commits, top = versions.history(spark, cache)
    before = versions.states(spark, cache, commits)
    files = scan_tree(spark, root).withColumnRenamed("file_path", "path")
    if only is not None:
        files, before = (df.where(F.col("path").isin(*only)) for df in (files, before))
    todo, gone = versions.changes(files, before)
    todo = todo.persist()  # hash and elements of one reading
    batch = versions.new_batch(top + 1)
    rows = parse.parse_files(todo.withColumnRenamed("path", "file_path"), parser, project).persist()
    try:
        counts = {"files": todo.count(), "failed": rows.where("error IS NOT NULL").count(), "elements": rows.where("error IS NULL").count()}
        if not counts["files"] and gone.isEmpty():
            return counts
        good = rows.where("error IS NULL").drop("error")
        path = write_cache(explain(good) if explain else good, cache, f"{parser}/{batch}")
        failed = rows.where("error IS NOT NULL").select(F.col("file_path").alias("path"), "error")
        versions.commit(spark, cache, batch, versions.log_rows(batch, todo, failed, gone), top + 1, rows=path.removeprefix(cache.rstrip("/") + "/"))
    finally:
        rows.unpersist()
        todo.unpersist()
    return counts


def main(argv: list[str] | None = None) -> dict[str, int]:
    """Command line: parse a source tree into a cache."""
    a = argparse.ArgumentParser(description=main.__doc__)
    a.add_argument("--root-dir", required=True)
    a.add_argument("--output-dir", default="./ast_cache")
    a.add_argument("--parser-type", default="tree-sitter", choices=sorted(parse.PARSERS))
    a.add_argument("--project-module", default="")
    a.add_argument("--generate-explanations", action="store_true")
    a.add_argument("--llm-provider", default="offline")
    a.add_argument("--max-concurrent", type=int, default=5)
    o = a.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    explain = None
    if o.generate_explanations:
        from .. import providers

        explain = lambda e: providers.explain(e, providers.get_llm(o.llm_provider), concurrent=o.max_concurrent)
    told = analyse(spark, o.root_dir, o.output_dir, parser=o.parser_type, project=o.project_module, explain=explain)
    print(told)
    return told


if __name__ == "__main__":
    main()
