"""Fixed row types, and checks of tables against them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

_S, _L, _A = T.StringType(), T.LongType(), T.ArrayType(T.StringType())
PARAMETERS = T.ArrayType(T.StructType().add("name", _S).add("type", _S).add("default", _S))


def _row(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


ELEMENTS = _row(
    id=_S, type=_S, name=_S, docstring=_S, code=_S, file_path=_S, parameters=PARAMETERS, return_type=_S, decorators=_A, dependencies=_A, base_classes=_A,
    methods=_A, calls=_A, assignments=_A, explanation=_S, is_async=T.BooleanType(),
)
EDGES = _row(src=_S, dst=_S, rel_type=_S, context=_S, label=_S)
HITS = _row(query_id=_L, node_id=_L, rank=T.IntegerType(), score=T.DoubleType())
MANIFEST = _row(path=_S, mtime=_L, sha256=_S)
PROGRESS = _row(kind=_S, key=_S, sha256=_S, state=_S, at=T.TimestampType())


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Fields of the schema that the table lacks or has with another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in schema.fields if have.get(f.name) != f.dataType]


def violations(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, n): keys that are null or occur more than once; a table fit for use has none."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col(key).isNull() | (F.col("n") > 1))


def populated(df: DataFrame) -> bool:
    return not df.isEmpty()


def write_checked(df: DataFrame, path: str, schema: T.StructType | None = None, key: str = "id") -> DataFrame:
    """Write a table at a new path and return it as stored; refused if it lacks fields of the schema or has null or repeated keys.

    The rows are written aside first and checked as written, then take their place, so what is refused was never there.
    """
    lacking = missing_columns(df, schema) if schema is not None else []
    if lacking:
        raise ValueError(f"columns missing or of another type: {', '.join(lacking)}")
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.unchecked"
    df.write.mode("overwrite").parquet(aside)
    stored = spark.read.schema(df.schema).parquet(aside)
    bad = violations(stored, key).limit(3).collect()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if bad or fs.exists(p(path)):
        fs.delete(p(aside), True)
        raise ValueError(f"keys null or repeated, such as {', '.join(str(r[0]) for r in bad)}" if bad else f"{path} exists")
    fs.rename(p(aside), p(path))
    return spark.read.schema(df.schema).parquet(path)
