"""Property graph: edges by name, neighbourhood expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import work

RELATIONS = {"base_classes": "INHERITS_FROM", "calls": "CALLS", "dependencies": "DEPENDS_ON"}


#: What an edge's context says, by its kind.
CONTEXTS = {"INHERITS_FROM": "Class inheritance", "CALLS": "Function call", "DEPENDS_ON": "Module dependency"}


def build_edges(elements: DataFrame, relations: dict[str, str] = RELATIONS, *, context: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Edges from elements (id, name and lists of names) to the elements (of `among`, if given) so named; set semantics. With `context` the
    columns are those of schemas.EDGES, context null; with_properties sets it."""
    names = (elements if among is None else among).select(F.col("id").alias("dst"), "name")
    made = [
        elements.select(F.col("id").alias("src"), F.explode(c).alias("name")).distinct().join(names, "name")
        .select("src", "dst", F.lit(rel).alias("rel_type"), *([F.lit(None).cast("string").alias("context")] if context else []), F.when(F.lit(rel) == "INHERITS_FROM", None).otherwise(F.col("name")).alias("label"))
        for c, rel in relations.items()
    ]
    return reduce(DataFrame.unionByName, made).distinct()


def with_properties(edges: DataFrame) -> DataFrame:
    """Edges with their context, by kind; call_signature, the name called; import_path, the name depended on."""
    of = lambda kind: F.when(F.col("rel_type") == kind, F.col("label"))
    context = F.element_at(F.create_map(*(F.lit(x) for kind in CONTEXTS.items() for x in kind)), F.col("rel_type"))
    return edges.select("src", "dst", "rel_type", context.alias("context"), of("CALLS").alias("call_signature"), of("DEPENDS_ON").alias("import_path"))


def edge_changes(before: DataFrame, now: DataFrame, relations: dict[str, str] = RELATIONS, *, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What takes the edges of the elements `before` to those of `now`: sources (src) and targets (dst) whose edges go, and the
    edges that come. Ids are unique in each.

    An edge hangs on its source's lists and on its target's name. So edges go whose source is gone or lists other names, or
    whose target is gone or renamed; edges come from such sources to all names, and from all others only to names that an element
    has gained. What changed is stored first; everything else is joined with it, so what moves follows the change.
    """
    lists = [F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in relations]
    told = lambda df, was: df.select("id", F.col("name").alias(f"name{was}"), F.struct(*(c.alias(f"l{i}") for i, c in enumerate(lists))).alias(f"lists{was}"), F.lit(True).alias(f"in{was}"))
    both = told(before, 0).join(told(now, 1), "id", "full_outer")
    gone, new = F.col("in1").isNull(), F.col("in0").isNull()
    renamed, relisted = gone | new | ~F.col("name0").eqNullSafe(F.col("name1")), gone | new | ~F.col("lists0").eqNullSafe(F.col("lists1"))
    changed = both.select("id", "name1", renamed.alias("renamed"), relisted.alias("relisted"), gone.alias("gone"), new.alias("new")).where("renamed OR relisted")
    touched = work.stored(changed, f"{path or work.shared_dir(now.sparkSession)}/touched")
    sources, targets = touched.where("relisted").select(F.col("id").alias("src")), touched.where("renamed AND NOT new").select(F.col("id").alias("dst"))
    own = now["id"] == sources["src"]
    gained = touched.where("renamed AND NOT gone").select("id", F.col("name1").alias("name"))
    added = build_edges(now.join(sources, own, "left_semi"), relations, among=now).unionByName(build_edges(now.join(sources, own, "left_anti"), relations, among=gained))
    return sources, targets, added


def update_edges(edges: DataFrame, before: DataFrame, now: DataFrame, relations: dict[str, str] = RELATIONS) -> DataFrame:
    """The edges of `now`, from those of `before`: equal to build_edges(now)."""
    sources, targets, added = edge_changes(before, now, relations)
    return edges.join(sources, "src", "left_anti").join(targets, "dst", "left_anti").select(*edges.columns).unionByName(added)


def lookup_counts(hits: DataFrame, found: DataFrame, store: DataFrame) -> DataFrame:
    """(query_id, found, missing) of each query of hits: how many of the nodes that expansion found the store (node_id) has, and
    how many it lacks."""
    have = store.select("node_id").distinct().withColumn("_have", F.lit(1))
    n = found.select("query_id", "node_id").distinct().join(have, "node_id", "left").groupBy("query_id").agg(F.count("_have").alias("found"), F.count(F.when(F.col("_have").isNull(), 1)).alias("missing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return hits.select("query_id").distinct().join(n, "query_id", "left").select("query_id", zero("found"), zero("missing"))


def _both(edges: DataFrame, rel_types: tuple[str, ...]) -> DataFrame:
    e = edges.where(F.col("rel_type").isin(*rel_types))
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def neighbours(seeds: DataFrame, edges: DataFrame, depth: int = 1, rel_types: tuple[str, ...] = ("CALLS", "DEPENDS_ON")) -> DataFrame:
    """(seed, node, hop): nodes within `depth` undirected steps, with the fewest steps; the seed itself left out.

    seeds: column seed. Each round joins only the nodes new in the round before.
    """
    both = _both(edges, rel_types)
    start = seeds.select("seed").distinct()
    seen = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(both, front["node"] == both["a"]).select("seed", F.col("b").alias("node")).distinct()
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def _mark() -> list:
    """Aggregates over a list's nodes, equal for equal lists in any order."""
    return [F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("m0"), F.bit_xor(F.xxhash64(F.lit(1), F.col("node"))).alias("m1")]


def alike(lists: DataFrame) -> DataFrame:
    """(seed, like) of lists (seed, node; rows unique, without nulls): seeds with the same `like`, the least of them, have the same nodes.

    They meet by a mark of their nodes, so no row holds a list. Marks can be equal by chance: where the seeds of one have more nodes in
    all than each has, each of them stays by itself.
    """
    marked = lists.groupBy("seed").agg(*_mark())
    mark = [c for c in marked.columns if c != "seed"]
    told = marked.join(marked.groupBy(*mark).agg(F.min("seed").alias("like")), mark).select("seed", "like", "size")
    mixed = lists.join(told, "seed").select("like", "node", "size").distinct().groupBy("like", "size").count().where("count > size").select("like", F.lit(True).alias("mixed"))
    return told.join(mixed, "like", "left").select("seed", F.when(F.col("mixed"), F.col("seed")).otherwise(F.col("like")).alias("like"))


def reach(seeds: DataFrame, edges: DataFrame, depth: int = 1, rel_types: tuple[str, ...] = ("CALLS", "DEPENDS_ON"), *, path: str | None = None) -> DataFrame:
    """(seed, hop, n, least, most): how many nodes `neighbours` lists for each seed and hop, and the least and most of them.

    Pairs are listed only once for all seeds that have the same neighbours: from there on they reach the same nodes in as many steps.
    They also reach each other, all in the same hop, where each leaves out itself; so least and most are kept with the next to them.
    Seeds whose neighbours all differ have their pairs listed as in `neighbours`. Null ids are no nodes.
    What is read again is stored: the plan of all steps in one would hold that of the edges hundreds of times.
    """
    root = path or work.shared_dir(edges.sparkSession)
    both = work.stored(_both(edges, rel_types).where("a IS NOT NULL AND b IS NOT NULL"), f"{root}/steps")
    lists = work.stored(seeds.select("seed").distinct().join(both, F.col("seed") == F.col("a")).select("seed", F.col("b").alias("node")), f"{root}/lists")
    told = work.stored(alike(lists), f"{root}/alike")
    front = lists.join(told.where("seed = like"), "seed", "left_semi").select(F.col("seed").alias("like"), "node", F.lit(1).alias("hop"))
    seen = front = work.stored(front, f"{root}/hop1")
    for hop in range(2, depth + 1):
        step = front.join(both, F.col("node") == F.col("a")).select("like", F.col("b").alias("node")).distinct()
        front = work.stored(step.join(seen.select("like", "node"), ["like", "node"], "left_anti").withColumn("hop", F.lit(hop)), f"{root}/hop{hop}")
        seen = seen.unionByName(front)
    node, least, most = F.col("node"), F.col("least"), F.col("most")
    ends = seen.groupBy("like", "hop").agg(F.min(node).alias("least"), F.max(node).alias("most"))
    sums = seen.join(ends, ["like", "hop"]).groupBy("like", "hop", "least", "most").agg(
        F.count(F.lit(1)).alias("n"), F.max(node == F.col("like")).alias("own"), F.min(F.when(node > least, node)).alias("next"), F.max(F.when(node < most, node)).alias("last")
    )
    but = lambda end, then: F.when(F.col("own") & (F.col(end) == F.col("seed")), F.col(then)).otherwise(F.col(end)).alias(end)
    n = F.col("n") - F.col("own").cast("long")
    return told.join(sums, "like").select("seed", "hop", n.alias("n"), but("least", "next"), but("most", "last")).where("n > 0")


def expand(hits: DataFrame, edges: DataFrame, *, depth: int = 1, most: int = 50, rel_types: tuple[str, ...] = ("CALLS", "DEPENDS_ON"),
           repeat_seeds: bool = False) -> DataFrame:
    """Seeds first, then their neighbours with score 0.5 in order of the seed's rank and then of id, `most` in all.

    A node reached from several seeds counts once; seeds are repeated as neighbours only if asked.
    """
    near = neighbours(hits.select(F.col("node_id").alias("seed")), edges, depth, rel_types)
    found = hits.select("query_id", F.col("node_id").alias("seed"), "rank").join(near, "seed").groupBy("query_id", F.col("node").alias("node_id")).agg(F.min("rank").alias("via"))
    if not repeat_seeds:
        found = found.join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    every = hits.select("query_id", "node_id", "score", F.lit(0).alias("later"), F.col("rank").alias("via")).unionByName(
        found.select("query_id", "node_id", F.lit(0.5).alias("score"), F.lit(1).alias("later"), "via")
    )
    w = Window.partitionBy("query_id").orderBy("later", "via", "node_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "node_id", "rank", "score")


def by_name(seeds: DataFrame, elements: DataFrame, edges: DataFrame, depth: int = 1, rel_types: tuple[str, ...] = ("CALLS", "DEPENDS_ON")) -> DataFrame:
    """(seed, node, hop): nodes near any element that has the seed's name, themselves of other names.

    seeds: column seed; elements: id, name. Names need not be unique.
    """
    names = elements.select("id", "name")
    twins = seeds.select("seed").distinct().join(names.withColumnRenamed("id", "seed"), "seed").join(names.withColumnRenamed("id", "twin"), "name")
    near = neighbours(twins.select(F.col("twin").alias("seed")), edges, depth, rel_types).withColumnRenamed("seed", "twin")
    found = twins.join(near, "twin").join(names.select(F.col("id").alias("node"), F.col("name").alias("other")), "node").where("other <> name")
    return found.groupBy("seed", "node").agg(F.min("hop").alias("hop"))


def expand_all(hits: DataFrame, elements: DataFrame, edges: DataFrame, *, depth: int = 1, most: int = 50, rel_types: tuple[str, ...] = ("CALLS", "DEPENDS_ON"),
               columns: tuple[str, ...] = ("calls", "dependencies"), repeat_seeds: bool = False) -> DataFrame:
    """Seeds first, then what three ways find, in their order: by id, by name, by the names in the seeds' lists.

    A node counts once, by the first way that finds it; inside a way the seed's rank and then the id decide. Nodes that
    are no element are dropped. Also returned: way (0: seed).
    """
    seeds = hits.select(F.col("node_id").alias("seed")).distinct()
    ways = [
        neighbours(seeds, edges, depth, rel_types).select("seed", "node", F.lit(1).alias("way")),
        by_name(seeds, elements, edges, depth, rel_types).select("seed", "node", F.lit(2).alias("way")),
        by_target(elements.join(seeds, elements["id"] == seeds["seed"], "left_semi"), columns, elements).select("seed", "node", F.lit(3).alias("way")),
    ]
    near = reduce(DataFrame.unionByName, ways).join(elements.select(F.col("id").alias("node")), "node", "left_semi")
    found = hits.select("query_id", F.col("node_id").alias("seed"), "rank").join(near, "seed")
    found = found.groupBy("query_id", F.col("node").alias("node_id")).agg(F.min(F.struct("way", F.col("rank").alias("via"))).alias("least"))
    if not repeat_seeds:
        found = found.join(hits.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return seeds_first(hits, found.select("query_id", "node_id", F.lit(0.5).alias("score"), "least.way", "least.via"), most)


def seeds_first(hits: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Hits as way 0, then what was found (query_id, node_id, score, way, via), in order of way, via and id; `most` of each query."""
    every = hits.select("query_id", "node_id", "score", F.lit(0).alias("way"), F.col("rank").alias("via")).unionByName(found)
    w = Window.partitionBy("query_id").orderBy("way", "via", "node_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "node_id", "rank", "score", "way")


def hydrate(stored: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows and, of the graph's nodes, those not among them."""
    return stored.unionByName(nodes.join(stored.select(key), key, "left_anti"))


def paths(seeds: DataFrame, edges: DataFrame, rel_types: tuple[str, ...] = ("CALLS", "DEPENDS_ON")) -> DataFrame:
    """(seed, node, rel_types): neighbours in one step with the sorted kinds of edges between."""
    e = edges.where(F.col("rel_type").isin(*rel_types))
    both = e.select(F.col("src").alias("seed"), F.col("dst").alias("node"), "rel_type").unionByName(e.select(F.col("dst").alias("seed"), F.col("src").alias("node"), "rel_type"))
    return both.join(seeds.select("seed"), "seed", "left_semi").where("seed <> node").groupBy("seed", "node").agg(F.array_sort(F.collect_set("rel_type")).alias("rel_types"))


def build_graph(elements: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes first, then edges, written below `path`; returns both as stored."""
    spark = elements.sparkSession
    elements.write.mode("overwrite").parquet(f"{path}/nodes")
    nodes = spark.read.schema(elements.schema).parquet(f"{path}/nodes")
    edges = build_edges(nodes)
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    return nodes, spark.read.schema(edges.schema).parquet(f"{path}/edges")


def by_target(elements: DataFrame, columns: tuple[str, ...] = ("calls", "dependencies"), among: DataFrame | None = None) -> DataFrame:
    """(seed, node): elements (of `among`, if given) whose name the seed's lists hold, other names than the seed's own."""
    names = (elements if among is None else among).select(F.col("id").alias("node"), "name")
    wanted = elements.select(F.col("id").alias("seed"), F.col("name").alias("own"), F.explode(F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in columns)))).alias("name"))
    return wanted.where("name <> own").join(names, "name").select("seed", "node").distinct()
