"""Stored adjacency for expansion three ways: by id, by name, by the names in an element's lists.

An expansion keeps few nodes, seeds first, then by way, rank of the seed and id. So of a node's neighbours only the smallest ids can
ever be wanted: if a list gives anything, all that lists before it gave is in the result already, so what it repeats are seeds or
results. Of each list the first `most` + seeds ids are enough. The table holds these heads, HEAD ids at most, by way and key:
way 1 the neighbours of a node, way 2 the neighbours of all elements of a name that have another name, way 3 the
elements of a name. A hub is cut to its head in each task before its rows meet; queries through it read the head.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import work
from . import graph

#: Ids in a head; expansions that want more are made from the edges.
HEAD = 256
RELATIONS = ("CALLS", "DEPENDS_ON")


@dataclass(frozen=True)
class Adjacency:
    """heads (way, key, head) in buckets by key; keys (id, name, targets); the elements and edges they are of."""

    heads: DataFrame
    keys: DataFrame
    elements: DataFrame
    edges: DataFrame
    rel_types: tuple[str, ...]
    head: int


def _targets(columns: tuple[str, ...]) -> Column:
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    return F.array_compact(F.array_distinct(F.concat(*lists)))


def smallest(pairs: DataFrame, most: int) -> DataFrame:
    """(way, key, head): the `most` smallest distinct nodes of each way and key. Pairs are made distinct over all their columns, so
    that a hub is spread; each task then gives its smallest only."""
    turn = F.row_number().over(Window.partitionBy("way", "key").orderBy("node"))
    first = pairs.distinct().withColumn("_turn", turn).where(F.col("_turn") <= most)
    return first.groupBy("way", "key").agg(F.array_sort(F.collect_list("node")).alias("head"))


def build(elements: DataFrame, edges: DataFrame, path: str | None = None, *, rel_types: tuple[str, ...] = RELATIONS, columns: tuple[str, ...] = ("calls", "dependencies"), head: int = HEAD) -> Adjacency:
    """Store the heads of elements (id, name, lists of names) and edges (src, dst, rel_type). Neighbours that are no element are left
    out, as are steps from a node to itself; an element without a name has no second way and is in no third."""
    spark = elements.sparkSession
    root = path or work.shared_dir(spark)
    keys = work.stored(elements.select("id", "name", _targets(columns).alias("targets")), f"{root}/keys")
    names = keys.select("id", "name")
    steps = graph._both(edges, rel_types).where("a <> b").join(names.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b")
    by_id = steps.select(F.lit(1).alias("way"), F.col("a").cast("string").alias("key"), F.col("b").alias("node"))
    twins = steps.join(names.select(F.col("id").alias("a"), F.col("name").alias("key")), "a").where("b_name <> key")
    by_name = twins.select(F.lit(2).alias("way"), "key", F.col("b").alias("node"))
    members = names.where("name IS NOT NULL").select(F.lit(3).alias("way"), F.col("name").alias("key"), F.col("id").alias("node"))
    made = smallest(by_id.unionByName(by_name).unionByName(members), head)
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"adjacency_{uuid.uuid4().hex}"
    made.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key", "way").option("path", f"{root}/heads").saveAsTable(name)
    return Adjacency(spark.table(name), keys, elements, edges, rel_types, head)


def reached(hits: DataFrame, adj: Adjacency, need: int) -> DataFrame:
    """(query_id, node_id, way, via) of hits: for each hit and list the `need` smallest nodes."""
    told = hits.select("query_id", F.col("node_id").alias("id"), F.col("rank").alias("via")).join(adj.keys, "id", "left")  # a hit that is no element has neighbours all the same
    key = lambda way, c: F.struct(F.lit(way).alias("way"), c.cast("string").alias("key"))
    others = F.transform(F.filter("targets", lambda t: t != F.col("name")), lambda t: key(3, t))
    asked = told.select("query_id", "via", F.inline(F.concat(F.array(key(1, F.col("id")), key(2, F.col("name"))), F.coalesce(others, F.array().cast("array<struct<way:int,key:string>>")))))
    return asked.join(adj.heads, ["way", "key"]).select("query_id", F.explode(F.slice("head", 1, need)).alias("node_id"), "way", "via")


def expand(hits: DataFrame, adj: Adjacency, *, seeds: int, depth: int = 1, most: int = 50, repeat_seeds: bool = False) -> DataFrame:
    """As graph.expand_all, from stored heads: seeds first, then what the three ways find, `most` in all; also way (0: seed).

    seeds: the most hits that a query has. More steps than one, or more nodes than heads hold, go by the edges.
    """
    need = most + seeds
    if depth > 1 or need > adj.head:
        return graph.expand_all(hits, adj.elements, adj.edges, depth=depth, most=most, rel_types=adj.rel_types, repeat_seeds=repeat_seeds)
    found = reached(hits, adj, need).groupBy("query_id", "node_id").agg(F.min(F.struct("way", "via")).alias("least"))
    if not repeat_seeds:
        found = found.join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return graph.seeds_first(hits, found.select("query_id", "node_id", F.lit(0.5).alias("score"), "least.way", "least.via"), most)
