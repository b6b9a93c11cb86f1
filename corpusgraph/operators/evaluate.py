"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

K_VALUES = (1, 3, 5, 10, 15, 20)


def metrics(hits: DataFrame, queries: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """(query_id, k, precision, recall, f1, ndcg, reciprocal_rank) for every query, also those without hits.

    Precision divides by how many were retrieved in the first k; recall by the number of relevant nodes.
    """
    size = qrels.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    base = queries.select("query_id").distinct().join(size, "query_id", "left").fillna({"relevant": 0})
    return metrics_of(hits, base, qrels, k_values)


def metrics_of(hits: DataFrame, base: DataFrame, qrels: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """As metrics, with the number of relevant nodes given for each query (query_id, relevant)."""
    judged = hits.select("query_id", "node_id", "rank").join(qrels.distinct().withColumn("rel", F.lit(1)), ["query_id", "node_id"], "left").fillna({"rel": 0})
    per = judged.groupBy("query_id")
    discount = F.col("rel") / F.log2(F.col("rank") + F.lit(1))
    columns = [F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")]
    for k in k_values:
        inside = F.col("rank") <= k
        columns += [F.count(F.when(inside, 1)).alias(f"n{k}"), F.coalesce(F.sum(F.when(inside, F.col("rel"))), F.lit(0)).alias(f"h{k}"), F.coalesce(F.sum(F.when(inside, discount)), F.lit(0.0)).alias(f"d{k}")]
    wide = base.join(per.agg(*columns), "query_id", "left")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"n{k}", F.lit(0)).alias("n"), F.coalesce(f"h{k}", F.lit(0)).alias("h"), F.coalesce(f"d{k}", F.lit(0.0)).alias("d")) for k in k_values)))
    long = wide.select("query_id", "relevant", "first", rows.alias("x")).select("query_id", "relevant", "first", "x.*")
    p = F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("relevant") > 0, F.col("h") / F.col("relevant")).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", F.col("relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1)))
    long = long.withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    ndcg = F.when(F.col("relevant") > 0, F.col("d") / F.when(F.col("relevant") > 0, ideal)).otherwise(0.0)
    rounded = lambda c, name: F.round(c, 6).alias(name)
    return long.select("query_id", "k", rounded(F.col("p"), "precision"), rounded(F.col("r"), "recall"), rounded(f1, "f1"), rounded(ndcg, "ndcg"),
                       rounded(F.coalesce(1 / F.col("first"), F.lit(0.0)), "reciprocal_rank"))


def mean(metric: str) -> Column:
    """Mean of a metric to three places. Metrics have six places, so their sum as decimals is exact and no order of rows moves a tie."""
    return F.round(F.avg(F.col(metric).cast("decimal(20,6)")), 3).cast("double")


def by_k(m: DataFrame) -> DataFrame:
    return m.groupBy("k").agg(*(mean(c).alias(c) for c in ("precision", "recall", "f1", "ndcg")))


def by_category(m: DataFrame) -> DataFrame:
    return m.groupBy("category", "k").agg(*(mean(c).alias(c) for c in ("precision", "recall", "f1")))


def pivot_f1(m: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    p = m.groupBy("category").pivot("k", list(k_values)).agg(mean("f1"))
    return p.select("category", *(F.col(str(k)).alias(f"f1_at_{k}") for k in k_values))


def quartiles(m: DataFrame) -> DataFrame:
    """Quartiles of precision by k, exact; selected in ranges, as a k has a row for every query."""
    q = quantiles(m, "k", "precision", (0.25, 0.5, 0.75)).groupBy("k").pivot("q", [0.25, 0.5, 0.75]).agg(F.round(F.first("value"), 4))
    return q.toDF("k", "q1", "q2", "q3")


def best_worst(m: DataFrame, k: int = 5, n: int = 3) -> DataFrame:
    at = m.where(F.col("k") == k).select("query_id", "f1")
    best = at.orderBy(F.desc("f1"), "query_id").limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(at.orderBy("f1", "query_id").limit(n).withColumn("side", F.lit("worst")))


def best_k(m: DataFrame) -> DataFrame:
    return by_k(m).orderBy(F.desc("f1"), "k").limit(1).select("k", "f1")


QUERIES = "query string, difficulty string, category string, relevant_elements array<string>"


def read_queries(spark, path: str) -> DataFrame:
    """(query_id, query, difficulty, category, relevant_elements) of a JSON file with one array of queries; ids are hashes of the texts."""
    rows = spark.read.schema(QUERIES).json(path, multiLine=True).distinct()
    return rows.withColumn("query_id", F.xxhash64("query")).select("query_id", *rows.columns)


def qrels(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("relevant_elements").alias("element")).distinct()


def count_by(rows: DataFrame, column: str = "category") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_by_name(hits: DataFrame) -> DataFrame:
    """Of the hits (query_id, name, rank) of one query with one name, the first; ranks follow anew. Hits without a name go."""
    first = hits.where("name IS NOT NULL").groupBy("query_id", "name").agg(F.min("rank").alias("was"))
    w = Window.partitionBy("query_id").orderBy("was", "name")
    return first.select("query_id", "name", F.row_number().over(w).alias("rank"))


def write_report(m: DataFrame, path: str) -> None:
    """Metrics and their means by k as CSV with a header, and a summary text."""
    m.write.mode("overwrite").csv(f"{path}/metrics", header=True)
    means = by_k(m)
    means.coalesce(1).write.mode("overwrite").csv(f"{path}/by_k", header=True)  # a row for each k
    line = F.format_string("k=%d precision=%.3f recall=%.3f f1=%.3f ndcg=%.3f", "k", "precision", "recall", "f1", "ndcg")
    means.orderBy("k").coalesce(1).select(line).write.mode("overwrite").text(f"{path}/summary")
