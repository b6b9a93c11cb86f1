"""The ten retrieval pipelines, by name. Each takes a Corpus and queries (query_id, text, embedding) and returns hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adjacency, graph, inverted, ranking


@dataclass(frozen=True)
class Corpus:
    """docs (node_id, text), vectors (node_id, embedding) and edges (src, dst, rel_type) over one id space. index gives the stored one of docs;
    without it lexical search builds one."""

    docs: DataFrame
    vectors: DataFrame | None = None
    edges: DataFrame | None = None
    scorer: ranking.Scorer = ranking.rerank_overlap
    metric: str = "cosine"
    index: Callable[[], inverted.TextIndex] | None = None
    adjacency: Callable[[], adjacency.Adjacency] | None = None


@dataclass(frozen=True)
class Options:
    k: int = 10
    initial_k: int | None = None
    fused_k: int | None = None
    cutoff: float | None = None
    depth: int = 1
    max_expansion_nodes: int = 50


Pipeline = Callable[[Corpus, DataFrame, Options], DataFrame]
REGISTRY: dict[str, Pipeline] = {}


#: The most hits that an expansion before a rerank starts from.
SEEDS = 50
#: Options that each pipeline uses.
USED: dict[Pipeline, set[str]] = {}


def register(name: str, *options: str) -> Callable[[Pipeline], Pipeline]:
    """options: what the pipeline uses besides k."""

    def put(f: Pipeline) -> Pipeline:
        REGISTRY[name] = f
        USED[f] = {"k", *options}
        return f

    return put


def get(name: str = "vector") -> Pipeline:
    f = REGISTRY.get(name.strip())
    if f is None:
        raise ValueError(f"unknown pipeline {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return f


def retrieve(name: str, corpus: Corpus, queries: DataFrame, **options) -> DataFrame:
    """Run a pipeline; options it does not know or use are an error, and the job fails at a blank or null query."""
    run = get(name)
    idle = [o for o in options if o not in USED.get(run, Options.__dataclass_fields__) and o in Options.__dataclass_fields__]
    if idle:
        raise ValueError(f"pipeline {name!r} does not use {', '.join(sorted(idle))}")
    blank = F.raise_error(F.concat(F.lit("a query is blank: "), F.col("query_id")))
    checked = F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("text")).otherwise(blank.cast("string"))
    return run(corpus, queries.withColumn("text", checked), Options(**options))


def _bm25(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return inverted.bm25(c.docs, q, k) if c.index is None else inverted.search(c.index(), q, k)


def _vector(c: Corpus, q: DataFrame, k: int) -> DataFrame:
    return ranking.vector(c.vectors, q, k, c.metric)


def _expand(c: Corpus, hits: DataFrame, o: Options, seeds: int) -> DataFrame:
    """seeds: how many hits a query has at most."""
    if c.adjacency is None:
        return graph.expand(hits, c.edges, depth=o.depth, most=o.max_expansion_nodes)
    return adjacency.expand(hits, c.adjacency(), seeds=seeds, depth=o.depth, most=o.max_expansion_nodes).drop("way")


def _rerank(c: Corpus, hits: DataFrame, q: DataFrame, k: int) -> DataFrame:
    return c.scorer(hits, c.docs, q, k)


@register("bm25")
def bm25(c, q, o):
    return _bm25(c, q, o.k)


@register("bm25_reranked", "initial_k")
def bm25_reranked(c, q, o):
    return _rerank(c, _bm25(c, q, o.initial_k or max(3 * o.k, 30)), q, o.k)


@register("bm25_graph_expanded", "initial_k", "depth", "max_expansion_nodes")
def bm25_graph_expanded(c, q, o):
    n = min(o.k, o.initial_k or max(2 * o.k, 30))
    return _expand(c, _bm25(c, q, n), o, n)


@register("bm25_graph_expanded_reranked", "initial_k", "depth", "max_expansion_nodes")
def bm25_graph_expanded_reranked(c, q, o):
    n = min(o.initial_k or max(3 * o.k, 30), SEEDS)
    return _rerank(c, _expand(c, _bm25(c, q, n), o, n), q, o.k)


@register("vector", "cutoff")
def vector(c, q, o):
    hits = _vector(c, q, o.k)
    return hits if o.cutoff is None else ranking.cutoff(hits, o.cutoff)


@register("vector_reranked", "initial_k", "cutoff")
def vector_reranked(c, q, o):
    hits = _rerank(c, _vector(c, q, o.initial_k or max(3 * o.k, 10)), q, o.k)
    return hits if o.cutoff is None else ranking.cutoff(hits, o.cutoff)


@register("hybrid_rrf", "initial_k")
def hybrid_rrf(c, q, o):
    n = o.initial_k or max(3 * o.k, 30)
    return ranking.rrf([_vector(c, q, n), _bm25(c, q, n)], o.k)


@register("hybrid_rrf_reranked", "fused_k")
def hybrid_rrf_reranked(c, q, o):
    n = max(3 * o.k, 30)
    return _rerank(c, ranking.rrf([_vector(c, q, n), _bm25(c, q, n)], o.fused_k or max(3 * o.k, 20)), q, o.k)


@register("bm25_graph_vector_rrf_reranked", "fused_k", "depth", "max_expansion_nodes")
def bm25_graph_vector_rrf_reranked(c, q, o):
    n = max(3 * o.k, 30)
    fused = ranking.rrf([_expand(c, _bm25(c, q, n), o, n), _vector(c, q, n)], o.fused_k or max(2 * o.k, 20))
    return _rerank(c, fused, q, o.k)


register("hybrid_graph_expanded", "fused_k", "depth", "max_expansion_nodes")(bm25_graph_vector_rrf_reranked)


def results(hits: DataFrame, elements: DataFrame, limit: int = 200) -> DataFrame:
    """Hits with file, type, name and the text's first characters; missing values are 'unknown'."""
    told = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    e = elements.select("node_id", told("file_path"), told("element_type"), told("element_name"), F.substring("text", 1, limit).alias("text"))
    return hits.join(e, "node_id").select("query_id", "node_id", "rank", "file_path", "element_type", "element_name", "score", "text")
