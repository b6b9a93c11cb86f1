"""Queries over code elements, each with its DuckDB SQL. Every part stands for one Python source file, made from its row."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from .. import engine, providers, schemas, work
from ..functions import text as X
from ..operators import adjacency, evaluate, graph, hashtree, incremental, inverted, learned, pivots, ranking
from ..operators.quantiles import quantiles
from ..sources import elements, manifest, parse, versions
from ..sources.prompts import Prompt
from . import pipelines
from .catalogue import _BM25, _EDGES, _HYBRID20, _META, _PLACES, _VEC, _adaptive_sql, _corpus, _doc_edges, _docs, _elements, _queries, _rerank_sql, _rrf_sql, _t, _vector_queries, _with_chars, query

_SOURCE = """import os
from rag.db import load_{c}, Store as S
from other import thing

class Part{k}(Base{b}, abc.Thing):
    "{name}"
    def show(self):
        return load_{c}(helper_{k}(1))
    @property
    def size(self):
        return S.get(self.x)

def helper_{k}(a, b: int, c=2):
    '''{brand}'''
    x = len(str(a))
    return Part{k}.make(os.path.join("a", "b"), thing.go(){end}
"""


def _files(spark, sf):
    """A file for each part; those whose number ends a run of eleven lack a bracket."""
    out, k = F.lit(_SOURCE), F.col("p_partkey").cast("string")
    for hole, value in (("{c}", (F.col("p_partkey") % 3).cast("string")), ("{b}", (F.col("p_partkey") % 5).cast("string")), ("{k}", k), ("{name}", F.col("p_name")),
                        ("{brand}", F.col("p_brand")), ("{end}", F.when(F.col("p_partkey") % 11 == 10, "").otherwise(")"))):
        out = F.replace(out, F.lit(hole), value)
    path = F.concat(F.lit("rag/m"), F.col("p_partkey") % 7, F.lit("/part_"), k, F.lit(".py"))
    return _t(spark, sf, "part").select(path.alias("file_path"), out.alias("source"))


def _code(spark, sf, parser="tree-sitter"):
    return parse.parse_files(_files(spark, sf), parser, "rag")


_MODULE = "'rag.m' || p_partkey % 7 || '.part_' || p_partkey"
_FILE = "'rag/m' || p_partkey % 7 || '/part_' || p_partkey || '.py'"
_BAD = "SELECT {file} AS file_path, NULL AS name, NULL AS type, NULL AS docstring, NULL AS params, NULL AS bases, NULL AS methods, NULL AS calls, NULL AS deps, NULL AS assigned, true AS failed FROM part WHERE p_partkey % 11 = 10"
_GOOD = "SELECT {file} AS file_path, {module} || '.{suffix}' || p_partkey AS name, '{kind}' AS type, {doc} AS docstring, {params} AS params, {bases} AS bases, {methods} AS methods, {calls} AS calls, {deps} AS deps, {assigned} AS assigned, false AS failed FROM part WHERE p_partkey % 11 <> 10"


def _parsed_sql(klass: dict, function: dict) -> str:
    one = lambda kind, suffix, doc, more: _GOOD.format(file=_FILE, module=_MODULE, kind=kind, suffix=suffix, doc=doc, **({"params": "''", "bases": "''", "methods": "''", "calls": "''", "assigned": "''"} | more))
    return " UNION ALL ".join([one("class", "Part", "p_name", klass), one("function", "helper_", "p_brand", function), _BAD.format(file=_FILE)])


_BASES = "'Base' || p_partkey % 5 || ',abc.Thing'"


def _shown(e):
    listed = lambda c: F.array_join(c, ",")
    params = F.when(F.col("error").isNull(), F.coalesce(X.format_parameters(F.col("parameters")), F.lit("")))
    return e.select("file_path", "name", "type", "docstring", params.alias("params"), listed("base_classes").alias("bases"), listed("methods").alias("methods"),
                    listed("calls").alias("calls"), listed("dependencies").alias("deps"), listed("assignments").alias("assigned"), F.col("error").isNotNull().alias("failed"))


_TREE_SQL = _parsed_sql(
    {"bases": _BASES, "methods": "'show'", "calls": f"'S.get,rag.db.load_' || p_partkey % 3 || ',' || {_MODULE} || '.helper_' || p_partkey", "deps": "'rag.db.load_' || p_partkey % 3"},
    {"params": "'a:Any'", "calls": f"'os.path.join,other.thing.go,' || {_MODULE} || '.Part' || p_partkey", "deps": "'rag.db.load_' || p_partkey % 3"},
)


@query(_TREE_SQL)
def parse_elements(spark, sf):
    return _shown(_code(spark, sf))


@query(_parsed_sql(
    {"bases": _BASES, "methods": f"{_MODULE} || '.Part' || p_partkey || '.show,' || {_MODULE} || '.Part' || p_partkey || '.size'", "deps": "'rag.db.Store,rag.db.load_' || p_partkey % 3"},
    {"params": "'a:Any, b:int, c:Any'", "calls": "'Part' || p_partkey || '.make,len,os.path.join,str,thing.go'", "deps": "'rag.db.Store,rag.db.load_' || p_partkey % 3", "assigned": "'x'"},
))
def parse_elements_ast(spark, sf):
    return _shown(_code(spark, sf, "ast"))


# --- caches, documents, nodes --------------------------------------------------------------------------------------

_NAMED = "SELECT {file} AS file_path, {module} || '.Part' || p_partkey AS name, p_name AS docstring FROM part WHERE p_partkey % 11 <> 10".format(file=_FILE, module=_MODULE)


@query("""SELECT 'cache/' || p_partkey || '.json' AS json_path, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_name END AS name,
CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN 'cache/' || p_partkey || '.json' ELSE p_brand || '.py' END AS file_path,
CAST(CASE p_partkey % 7 WHEN 0 THEN -2 WHEN 1 THEN -2 WHEN 2 THEN -1 WHEN 4 THEN 1 ELSE 0 END AS INT) AS n_calls,
CASE p_partkey % 7 WHEN 0 THEN 'not a JSON object of the schema' WHEN 1 THEN 'unknown keys: colour' END AS error FROM part""")
def cache_decode(spark, sf):
    k, quoted = F.col("p_partkey") % 7, lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    head = F.concat(F.lit('{"id": "x", "type": "class", "name": '), quoted("p_name"))
    path = F.concat(F.lit(', "file_path": "'), F.col("p_brand"), F.lit('.py"'))
    more = F.when(k == 1, F.concat(path, F.lit(', "colour": 1}'))).when(k == 2, F.concat(path, F.lit(', "calls": null}'))).when(k == 3, F.lit("}"))
    more = more.when(k == 4, F.concat(path, F.lit(', "calls": ["a.b"]}'))).otherwise(F.concat(path, F.lit("}")))
    own = F.concat(F.lit("cache/"), F.col("p_partkey"), F.lit(".json"))
    rows = _t(spark, sf, "part").select(own.alias("file_path"), F.when(k == 0, '{"type": "cla').otherwise(F.concat(head, more)).alias("json"))
    got = elements.decode(rows).withColumn("n_calls", F.when(F.col("error").isNull(), F.coalesce(F.size("calls"), F.lit(-1))).otherwise(-2))
    return got.select("json_path", "name", F.when(F.col("error").isNull(), F.col("file_path")).alias("file_path"), "n_calls", "error")


def _good(spark, sf):
    return _code(spark, sf).where("error IS NULL AND type = 'class'")


def _columns(df):
    return {c: F.col(c) for c in df.columns}


@query(f"SELECT file_path, name, docstring, CAST(0 AS INT) AS n_parameters, CAST(3 AS INT) AS n_calls, '' AS return_type, '' AS explanation, CAST(16 AS INT) AS n_fields FROM ({_NAMED})")
def element_documents(spark, sf):
    e = _good(spark, sf)
    d = X.element_document(_columns(e))
    made = e.select(*(c.alias(n) for n, c in d.items()))
    return made.select("file_path", "name", "docstring", F.size("parameters").alias("n_parameters"), F.size("calls").alias("n_calls"), "return_type", "explanation", F.lit(len(d)).alias("n_fields"))


@query(f"""SELECT file_path, 'CLASS: ' || name || chr(10) || 'File: ' || file_path || chr(10) || chr(10) || 'class ' AS head,
'base_classes,calls,dependencies,file_path,id,methods,name,type' AS keys, 'Base' || k % 5 || ',abc.Thing' AS bases
FROM (SELECT *, CAST(regexp_extract(name, '[0-9]+$') AS INT) AS k FROM ({_NAMED}))""")
def element_nodes(spark, sf):
    e = _good(spark, sf)
    m, text = X.node_metadata(_columns(e)), X.node_text(_columns(e))
    return e.select("file_path", F.regexp_extract(text, r"(?s)^.*?\n\nclass ", 0).alias("head"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), m["base_classes"].alias("bases"))


@query(f"SELECT name, file_path, 'class' AS type, 'Name: ' || name || chr(10) || 'Type: class' || chr(10) || 'File: ' || file_path || chr(10) || 'Description: ' || docstring AS head FROM ({_NAMED})")
def text_nodes(spark, sf):
    e = _good(spark, sf)
    n = e.select(X.text_node(_columns(e)).alias("n")).select("n.*")
    return n.select("name", "file_path", "type", F.array_join(F.slice(F.split("text", "\n"), 1, 4), "\n").alias("head"))


_RESULT_SQL = """SELECT query_id, node_id, rank, coalesce(nullif(source, ''), 'unknown') AS file_path, coalesce(nullif(lang, ''), 'unknown') AS element_type, 'unknown' AS element_name,
 score, substr(text, 1, 200) AS text FROM h JOIN documents ON doc_id = node_id"""


def _doc_elements(spark, sf):
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.col("source").alias("file_path"), F.col("lang").alias("element_type"), F.lit("").alias("element_name"), "text")


@query(f"WITH {_BM25}, h AS (SELECT * FROM bmr WHERE rank <= 5) {_RESULT_SQL}")
def retrieve_documents(spark, sf):
    made = engine.Engine(spark, _corpus(spark, sf), _doc_elements(spark, sf), engine.Settings(pipeline="bm25"))
    return made.retrieve(_queries(spark, sf), k=5)


@query(f"""WITH {_BM25}, q AS (SELECT DISTINCT item_id AS query_id, text AS q FROM benchmark),
h AS (SELECT query_id, rank, coalesce(text, '') AS text FROM bmr JOIN documents ON doc_id = node_id WHERE rank <= 2)
SELECT query_id, 'Context:' || chr(10) || coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '') || chr(10) || chr(10) || 'Name: ' || any_value(q) || chr(10) || 'Answer from the context alone.' AS prompt,
 CAST(count(rank) AS INT) AS selected_k, CASE WHEN count(rank) = 0 THEN 'no_candidates' ELSE 'insufficient_candidates' END AS stopped_reason FROM q LEFT JOIN h USING (query_id) GROUP BY query_id""")
def answer_context(spark, sf):
    made = engine.Engine(spark, _corpus(spark, sf), _doc_elements(spark, sf), engine.Settings(pipeline="bm25", top_k=2))
    return made.contexts(_queries(spark, sf))


@query("SELECT doc_id, CAST(len(embedding) AS INT) AS dimension FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id IS NOT NULL")
def embedding_ready(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    ready = _t(spark, sf, "documents").where("doc_id IS NOT NULL").select("doc_id")
    return providers.checked_dimension(incremental.attach(ready, e, "doc_id"), 64).select("doc_id", F.size("embedding").alias("dimension"))


@query(r"""WITH w AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{2,}')) AS w FROM part),
b AS (SELECT p_partkey, CAST('0x' || substr(md5(w), 1, 4) AS INT) % 8 AS place FROM w)
SELECT p_partkey, concat_ws(',', count(*) FILTER (WHERE place = 0), count(*) FILTER (WHERE place = 1), count(*) FILTER (WHERE place = 2), count(*) FILTER (WHERE place = 3),
 count(*) FILTER (WHERE place = 4), count(*) FILTER (WHERE place = 5), count(*) FILTER (WHERE place = 6), count(*) FILTER (WHERE place = 7)) AS embedding FROM b GROUP BY p_partkey""")
def embed_texts(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"))
    made = providers.populate_embeddings(p, providers.get_embeddings("offline", dimension=8), key="p_partkey")
    return made.select("p_partkey", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


@query(f"SELECT file_path, 'Explains ' || name || '.' AS explanation FROM ({_NAMED})")
def explanations(spark, sf):
    return providers.explain(_good(spark, sf), providers.get_llm("offline")).select("file_path", "explanation")


_CARD = """You describe a Python {{ type }} so that it can be found by searching.
Type: {{ type }}
Name: {{ name }}
File: {{ file_path }}
{% if return_type %}Returns: {{ return_type }}{% endif %}
{% if docstring %}Docstring: {{ docstring }}{% endif %}
Code:
{{ code }}"""


@query(f"""SELECT file_path, 'You describe a Python class so that it can be found by searching.' || chr(10) || 'Type: class' || chr(10) || 'Name: ' || name || chr(10) || 'File: ' || file_path
 || chr(10) || 'Docstring: ' || docstring || chr(10) || 'Code:' AS head FROM ({_NAMED})""")
def prompt_render(spark, sf):
    e, p = _good(spark, sf), Prompt("card", _CARD)
    values = _columns(e) | {"parameters": X.format_parameters(F.col("parameters"))}
    return e.select("file_path", F.array_join(F.slice(F.split(p.render(values), "\n"), 1, 6), "\n").alias("head"))


# --- graph ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_PLACES} SELECT src, dst, rel_type, CAST(NULL AS VARCHAR) AS context, label FROM places")
def edge_table(spark, sf):
    e = graph.build_edges(_elements(spark, sf), context=True)
    lacking = schemas.missing_columns(e, schemas.EDGES)
    if lacking:
        raise ValueError(f"edges lack {', '.join(lacking)}")
    return e


# Elements that share names: suppliers go by their nation's name.
_TWINS = """els AS (SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region
 UNION ALL SELECT 'supplier:' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer)"""


def _twin_elements(spark, sf):
    """As _elements, with suppliers named after their nations, so names repeat."""
    e = _elements(spark, sf)
    return e.withColumn("name", F.when(F.col("id").startswith("supplier:"), F.element_at("dependencies", 1)).otherwise(F.col("name")))


@query(f"""WITH {_PLACES}, {_TWINS}, seeds AS (SELECT id, name FROM els WHERE id LIKE 'nation:%')
SELECT s.id AS seed, count(DISTINCT o.id) AS n, min(o.id) AS least, max(o.id) AS most FROM seeds s JOIN els t USING (name) JOIN ways w ON w.a = t.id JOIN els o ON o.id = w.b WHERE o.name <> s.name AND w.b <> t.id GROUP BY s.id""")
def expand_by_name(spark, sf):
    e = _twin_elements(spark, sf)
    near = graph.by_name(e.where("id LIKE 'nation:%'").select(F.col("id").alias("seed")), e, graph.build_edges(_elements(spark, sf)))
    return near.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))


def _doc_graph(spark, sf):
    """Documents as elements named by language and number in twos; each refers to the name of the next but two."""
    name = lambda k: F.concat(F.col("lang"), F.lit("-"), F.floor((F.col("doc_id") + k) / 2).cast("string"))
    d = _t(spark, sf, "documents")
    none = F.array().cast("array<string>")
    return d.select(F.col("doc_id").alias("id"), name(0).alias("name"), F.array(name(3)).alias("calls"), none.alias("dependencies"))


def _three_ways_sql(name: str, k: int, most: int = 50) -> str:
    """CTEs that end in <name>: BM25 to k, then what the three ways find, with its way."""
    return f"""
seeds AS (SELECT * FROM bmr WHERE rank <= {k}),
els AS (SELECT doc_id AS id, lang || '-' || doc_id // 2 AS name, lang || '-' || (doc_id + 3) // 2 AS target FROM documents),
one AS (SELECT s.query_id, w.b AS node, 1 AS way, s.rank FROM seeds s JOIN both_ways w ON w.a = s.node_id WHERE w.b <> s.node_id),
two AS (SELECT s.query_id, o.id, 2, s.rank FROM seeds s JOIN els m ON m.id = s.node_id JOIN els t ON t.name = m.name JOIN both_ways w ON w.a = t.id JOIN els o ON o.id = w.b WHERE o.name <> m.name AND w.b <> t.id),
three AS (SELECT s.query_id, o.id, 3, s.rank FROM seeds s JOIN els m ON m.id = s.node_id JOIN els o ON o.name = m.target WHERE m.target <> m.name),
allw AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
firsts AS (SELECT query_id, node, min(struct_pack(way := way, rank := rank)) AS f FROM allw WHERE node IN (SELECT id FROM els) GROUP BY ALL),
every AS (SELECT query_id, node_id, score, 0 AS way, rank AS via FROM seeds UNION ALL
 SELECT query_id, node, 0.5, f.way, f.rank FROM firsts WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = firsts.query_id AND z.node_id = firsts.node)),
{name} AS (SELECT query_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY way, via, node_id) AS INT) AS rank, score, CAST(way AS INT) AS way FROM every QUALIFY rank <= {most})"""


_UNION_SQL = f"WITH {_BM25}, {_EDGES}, {_three_ways_sql('x', 10)} SELECT * FROM x"


@query(f"""WITH {_PLACES} SELECT src, dst, rel_type, CASE rel_type WHEN 'CALLS' THEN 'Function call' WHEN 'DEPENDS_ON' THEN 'Module dependency' ELSE 'Class inheritance' END AS context,
 CASE WHEN rel_type = 'CALLS' THEN label END AS call_signature, CASE WHEN rel_type = 'DEPENDS_ON' THEN label END AS import_path FROM places""")
def edge_properties(spark, sf):
    return graph.with_properties(graph.build_edges(_elements(spark, sf)))


def _edited(e):
    """The elements after edits: a nation renamed, another with a namesake, customers gone, suppliers that moved, and a new customer."""
    n = F.substring_index("id", ":", -1).try_cast("int")
    kind = lambda k: F.col("id").startswith(f"{k}:")
    moved = F.when(kind("supplier") & (n % 7 == 1), F.array(F.lit("CHINA"))).otherwise(F.col("dependencies"))
    e = e.where(~(kind("customer") & (n % 10 == 3))).withColumn("dependencies", moved)
    e = e.withColumn("name", F.when(F.col("id") == "nation:5", "RENAMED").otherwise(F.col("name")))
    twin = e.where("id = 'nation:7'").withColumn("id", F.lit("nation:twin"))
    return e.unionByName(twin).unionByName(e.where("id = 'customer:1'").withColumns({"id": F.lit("customer:new"), "name": F.lit("new"), "calls": F.array(F.lit("RENAMED"))}))


@query("""WITH n AS (SELECT 'nation:' || n_nationkey AS id, CASE WHEN n_nationkey = 5 THEN 'RENAMED' ELSE n_name END AS name, n_regionkey FROM nation
 UNION ALL SELECT 'nation:twin', n_name, n_regionkey FROM nation WHERE n_nationkey = 7),
c AS (SELECT 'customer:' || c_custkey AS src, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 3
 UNION ALL SELECT 'customer:new', 'RENAMED' FROM customer WHERE c_custkey = 1),
s AS (SELECT 'supplier:' || s_suppkey AS src, CASE WHEN s_suppkey % 7 = 1 THEN 'CHINA' ELSE n_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id AS src, 'region:' || r_regionkey AS dst, 'INHERITS_FROM' AS rel_type, NULL AS label FROM n JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT src, id, 'CALLS', name FROM c JOIN n USING (name) UNION ALL SELECT src, id, 'DEPENDS_ON', name FROM s JOIN n USING (name)""")
def edge_update(spark, sf):
    before = _elements(spark, sf)
    return graph.update_edges(graph.build_edges(before), before, _edited(before))


@query(f"""WITH {_BM25}, {_EDGES}, {_three_ways_sql('x', 10)} SELECT query_id, count(*) FILTER (WHERE way > 0 AND vec_id IS NOT NULL) AS found, count(*) FILTER (WHERE way > 0 AND vec_id IS NULL) AS missing
FROM x LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = node_id GROUP BY query_id""")
def expansion_lookup(spark, sf):
    c = _graph_corpus(spark, sf)
    x = adjacency.expand(inverted.search(c.index(), _queries(spark, sf), 10), c.adjacency(), seeds=10)
    return graph.lookup_counts(x, x.where("way > 0"), c.vectors)


_EUCLID = """SELECT query_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS rank, score FROM (
 SELECT e.vec_id AS node_id, q.item_id AS query_id, round(1 / (1 + list_distance(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) ** 2), 6) AS score
 FROM embeddings e, benchmark q JOIN embeddings x ON x.vec_id = q.item_id) QUALIFY rank <= 10"""


@query(_EUCLID)
def vector_euclidean(spark, sf):
    return pipelines.retrieve("vector", dataclasses.replace(_corpus(spark, sf), metric="euclidean"), _vector_queries(spark, sf), k=10)


@query(f"WITH {_VEC} SELECT * FROM ver WHERE rank <= 10")
def vector_pivots(spark, sf):
    c = _corpus(spark, sf)
    return pivots.search(pivots.build(c.vectors), _vector_queries(spark, sf), 10)


@query()
def rerank_learned(spark, sf):
    """Items with odd numbers, their hits ranked by a model fitted on those with even ones; documents of good quality are relevant."""
    c, q = _corpus(spark, sf), _queries(spark, sf)
    hits = inverted.search(c.index(), q, 30)
    good = _t(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("node_id")).distinct()
    model = learned.fit(hits.where("query_id % 2 = 0"), c.docs, q, hits.join(good, "node_id", "left_semi"))
    return model(hits.where("query_id % 2 = 1"), c.docs, q, 10)


@query(_UNION_SQL)
def expand_three_ways(spark, sf):
    return graph.expand_all(inverted.search(_corpus(spark, sf).index(), _queries(spark, sf), 10), _doc_graph(spark, sf), _doc_edges(spark, sf))


_ADJACENCIES: dict[tuple, adjacency.Adjacency] = {}


def _graph_corpus(spark, sf):
    """The corpus with its adjacency, which is stored once a session for each state of the text index's table."""

    def stored():
        key = inverted.state(spark, f"{sf}/documents.parquet")
        if key not in _ADJACENCIES:
            _ADJACENCIES[key] = adjacency.build(_doc_graph(spark, sf), _doc_edges(spark, sf))
        return _ADJACENCIES[key]

    return dataclasses.replace(_corpus(spark, sf), adjacency=stored)


@query(f"WITH {_BM25}, {_EDGES}, {_three_ways_sql('x', 10)} SELECT * EXCLUDE (way) FROM x")
def bm25_graph_three_ways(spark, sf):
    return pipelines.retrieve("bm25_graph_expanded", _graph_corpus(spark, sf), _queries(spark, sf), k=10)


@query(f"WITH {_BM25}, {_EDGES}, {_three_ways_sql('x', 30)} {_rerank_sql('x', 10)}")
def bm25_graph_three_ways_reranked(spark, sf):
    return pipelines.retrieve("bm25_graph_expanded_reranked", _graph_corpus(spark, sf), _queries(spark, sf), k=10)


_FUSED_THREE = f"{_VEC}, {_BM25}, {_EDGES}, {_three_ways_sql('x', 30)}, v AS (SELECT * FROM ver WHERE rank <= 30)"


@query(f"WITH {_FUSED_THREE}, f AS ({_rrf_sql(['x', 'v'], 20)}) {_rerank_sql('f', 10)}")
def hybrid_graph_three_ways_reranked(spark, sf):
    return pipelines.retrieve("hybrid_graph_expanded", _graph_corpus(spark, sf), _vector_queries(spark, sf), k=10)


@query(f"WITH {_PLACES} SELECT a AS seed, b AS node, kinds AS rel_types FROM (SELECT a, b, 'DEPENDS_ON' AS kinds FROM ways WHERE a LIKE 'supplier:%')")
def path_types(spark, sf):
    e = _elements(spark, sf)
    seeds = e.where("id LIKE 'supplier:%'").select(F.col("id").alias("seed"))
    return graph.paths(seeds, graph.build_edges(e)).select("seed", "node", F.array_join("rel_types", ",").alias("rel_types"))


@query("SELECT doc_id AS id, 'stored' AS origin FROM documents JOIN embeddings ON vec_id = doc_id UNION ALL SELECT doc_id, 'graph' FROM documents ANTI JOIN embeddings ON vec_id = doc_id")
def hydrate_union(spark, sf):
    nodes = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("graph").alias("origin"))
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return graph.hydrate(nodes.join(vectors, "id", "left_semi").withColumn("origin", F.lit("stored")), nodes)


@query("SELECT event_id, 'event_type,k,user_id' AS keys FROM events")
def metadata_keys(spark, sf):
    m = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("text"), F.col("props"), F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"),
                     F.lit("embedding"), F.lit(""), F.lit("k"), F.get_json_object("props", "$.k"))
    return _t(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(X.without_keys(m, "id", "text", "embedding"))), ",").alias("keys"))


# --- counts, progress, manifests -----------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (WHERE vec_id IN (SELECT doc_id FROM documents)) AS updated, count(*) FILTER (WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)) AS unmatched FROM embeddings")
def attached_count(spark, sf):
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return incremental.attached_count(_t(spark, sf, "documents"), e, "doc_id")


@query("SELECT source AS id, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1 OR source IS NULL")
def key_violations(spark, sf):
    return schemas.violations(_t(spark, sf, "documents").select(F.col("source").alias("id")))


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def count_by_category(spark, sf):
    return evaluate.count_by(_t(spark, sf, "documents").withColumnRenamed("lang", "category"))


@query(f"""WITH {_BM25}, h AS (SELECT query_id, rank, CASE WHEN node_id % 3 = 0 THEN 'n' || node_id % 5 ELSE 't' || node_id % 4 END AS name FROM bmr WHERE rank <= 20),
f AS (SELECT query_id, name, min(rank) AS was FROM h GROUP BY ALL)
SELECT query_id, name, CAST(row_number() OVER (PARTITION BY query_id ORDER BY was, name) AS INT) AS rank FROM f""")
def eval_names(spark, sf):
    hits = inverted.search(_corpus(spark, sf).index(), _queries(spark, sf), 20)
    k = F.col("node_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("n"), k % 5)).otherwise("unknown")
    text = F.concat(F.lit("Type: x\nName: t"), k % 4, F.lit("\nFile: f\nName: late"))
    return evaluate.first_by_name(hits.select("query_id", "rank", X.eval_name(name, text).alias("name")))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) // 1000 AS millis FROM events")
def timestamps(spark, sf):
    t = F.col("ts").cast("timestamp")
    return _t(spark, sf, "events").select("event_id", X.stamp(t).alias("stamp"), F.unix_timestamp(t).alias("seconds"), F.unix_millis(t).alias("millis"))


@query("SELECT CAST(len(embedding) AS VARCHAR) || ':cosine' AS signature, count(*) AS n FROM embeddings GROUP BY ALL")
def embed_signature(spark, sf):
    return _t(spark, sf, "embeddings").groupBy(X.embed_signature(F.size("embedding"), F.lit("cosine")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS processed, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS elapsed,
 round((epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / count(*), 6) AS average,
 round((epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / count(*) * (1000000 - count(*)), 6) AS remaining FROM events""")
def progress_eta(spark, sf):
    return incremental.progress_eta(_t(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at")), 1_000_000)


@query("""WITH f AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS sha FROM documents), d AS (SELECT path, CASE WHEN path % 5 = 1 THEN 'old' ELSE sha END AS sha FROM f WHERE path % 3 <> 0 AND path % 7 <> 2)
SELECT path, CASE WHEN path % 3 = 0 THEN 'new' WHEN path % 7 = 2 THEN 'failed' ELSE 'edited' END AS why FROM f ANTI JOIN d USING (path, sha)""")
def progress_retry(spark, sf):
    """Files to be parsed: new ones, those that failed and those edited since."""
    f = _t(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    k = F.col("path")
    log = f.where(k % 3 != 0).withColumn("state", F.when(k % 7 == 2, "failed").otherwise("done")).withColumn("sha256", F.when(k % 5 == 1, "old").otherwise(F.col("sha256")))
    left = incremental.unprocessed(f, log.where("state = 'done'"), "path", "sha256")
    known = log.select("path", "state")
    why = F.when(F.col("state").isNull(), "new").when(F.col("state") == "failed", "failed").otherwise("edited")
    return left.join(known, "path", "left").select("path", why.alias("why"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 IN (5, 7) THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 10 <> 3""")
def refresh_elements(spark, sf):
    """Rows after a refresh: those of changed and added files are built anew, those of removed files go."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("k"), F.col("n_chars").alias("mtime"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    before = d.where("k % 10 <> 7").withColumn("sha256", F.when(F.col("k") % 10 == 5, "old").otherwise(F.col("sha256")))
    now = d.where("k % 10 <> 3")
    changes = manifest.diff(manifest.Manifest(before.drop("k")), manifest.Manifest(now.drop("k")))
    return manifest.merged(before.select("path", F.lit("old").alias("version")), changes, lambda paths: paths.withColumn("version", F.lit("new")))


_MASSES = _adaptive_sql(_HYBRID20, _rrf_sql(["v", "b"], 20), 0.7, 0.005, 0.01, 0.001).rsplit("SELECT query_id, selected_k", 1)[0]


@query(f"""{_MASSES} SELECT query_id, any_value(stopped_reason) AS stopped_reason, CAST(count(*) AS INT) AS n_probabilities, round(max(p), 4) AS first_probability,
 round(max(CASE WHEN rank = selected_k THEN cm END), 4) AS reached_mass, round(max(cm), 4) AS whole_mass FROM s JOIN h4 USING (query_id) GROUP BY query_id""")
def adaptive_k_masses(spark, sf):
    hits = pipelines.retrieve("hybrid_rrf", _corpus(spark, sf), _vector_queries(spark, sf), k=20)
    a = ranking.adaptive_k(_with_chars(spark, sf, hits), temperature=0.005)
    at = lambda i: F.round(F.element_at("cumulative_masses", i), 4)
    return a.select("query_id", "stopped_reason", F.size("probabilities").alias("n_probabilities"), F.round(F.array_max("probabilities"), 4).alias("first_probability"),
                    at(F.col("selected_k")).alias("reached_mass"), at(F.lit(-1)).alias("whole_mass"))


@query("SELECT DISTINCT item_id + 1000000 AS query_id, 0 AS selected_k, 'no_candidates' AS stopped_reason, CAST(0 AS BIGINT) AS total_tokens, CAST(0 AS DOUBLE) AS total_cost FROM benchmark")
def adaptive_k_none(spark, sf):
    q = _queries(spark, sf).select((F.col("query_id") + 1_000_000).alias("query_id"))
    none = spark.createDataFrame([], "query_id long, rank int, score double, chars long")
    return ranking.adaptive_k(none, queries=q).select(*_META)


_FILES_SQL = """{name} AS (SELECT 'f' || doc_id // 4 AS path, doc_id, {n} AS n_chars FROM documents WHERE {where}),
h_{name} AS (SELECT path, string_agg(doc_id || ':' || n_chars, ',' ORDER BY doc_id) AS h FROM {name} GROUP BY path)"""


@query(f"""WITH {_FILES_SQL.format(name="old", n="n_chars", where="doc_id % 10 <> 3")},
{_FILES_SQL.format(name="now", n="n_chars + CASE WHEN doc_id % 50 = 5 THEN 1 ELSE 0 END", where="doc_id % 10 <> 3 AND doc_id // 4 % 10 <> 5")},
told AS (SELECT n.path, CASE WHEN o.h = n.h THEN 1 ELSE 2 END AS version FROM h_now n LEFT JOIN h_old o USING (path))
SELECT path, doc_id, n_chars, CAST(version AS INT) AS version FROM now JOIN told USING (path) WHERE version = 1 OR CAST(substr(path, 2) AS BIGINT) % 11 <> 3""")
def refresh_table(spark, sf):
    """Documents in files of four, in two states: some rows edited, some files gone, some that fail when they are read again."""
    d = _t(spark, sf, "documents").where("doc_id % 10 <> 3").select(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4)).alias("path"), "doc_id", "n_chars")
    number = F.substring("path", 2, 20).cast("long")
    now = d.where(number % 10 != 5).withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 50 == 5).cast("int"))
    root, bad = work.shared_dir(spark), F.when(number % 11 == 3, "cannot be read")
    for rows, error in ((d, F.lit(None).cast("string")), (now, bad)):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))), lambda r: F.concat(r["doc_id"], F.lit(":"), r["n_chars"])), ",")
        files = rows.groupBy("path").agg(F.sha2(text, 256).alias("sha256"))
        versions.refresh(spark, root, files, lambda todo, rows=rows, error=error: rows.join(todo.select("path"), "path", "left_semi").withColumn("error", error))
    return versions.read(spark, root).select("path", "doc_id", "n_chars", F.substring("batch", 1, 12).cast("int").alias("version"))


@query("""SELECT l_returnflag, l_linestatus, unnest([0.1, 0.5, 0.99]::DOUBLE[]) AS q, round(unnest(v), 4) AS value
FROM (SELECT l_returnflag, l_linestatus, quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.1, 0.5, 0.99]) AS v FROM lineitem GROUP BY ALL)""")
def price_quantiles(spark, sf):
    """Quantiles of prices over all line items, in few groups that each hold a large part of the table."""
    rows = _t(spark, sf, "lineitem").select(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("g"), F.col("l_extendedprice").alias("p"))
    out = quantiles(rows, "g", "p", (0.1, 0.5, 0.99))
    return out.select(F.substring_index("g", "/", 1).alias("l_returnflag"), F.substring_index("g", "/", -1).alias("l_linestatus"), "q", F.round("value", 4).alias("value"))


@query("""WITH f AS (SELECT concat_ws('/', source, lang, doc_id) AS path, doc_id, source, lang, n_chars AS mtime, sha256(coalesce(text, '')) AS h FROM documents),
now AS (SELECT path, mtime, CASE WHEN source = 'src3' AND doc_id % 10 = 5 THEN 'new' ELSE h END AS h FROM f WHERE NOT (source = 'src5' AND doc_id % 7 = 3)),
old AS (SELECT path, mtime, h FROM f WHERE NOT (source = 'src7' AND lang = 'en'))
SELECT path, CASE WHEN n.h IS NULL THEN 'removed' WHEN o.h IS NULL THEN 'added' ELSE 'changed' END AS change FROM now n FULL JOIN old o USING (path) WHERE n.h IS NULL OR o.h IS NULL OR n.h <> o.h""")
def snapshot_tree_diff(spark, sf):
    """Documents as files in folders by source and language; in the new snapshot some of one source are edited, of another removed, of a third added."""
    d = _t(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("mtime"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id", "source", "lang")
    edited = F.when((F.col("source") == "src3") & (F.col("doc_id") % 10 == 5), "new").otherwise(F.col("sha256"))
    now = d.where(~((F.col("source") == "src5") & (F.col("doc_id") % 7 == 3))).withColumn("sha256", edited)
    before = d.where(~((F.col("source") == "src7") & (F.col("lang") == "en")))
    return hashtree.diff(hashtree.build(before), hashtree.build(now))
