"""Parsers, caches, manifests, prompts, providers, the facade and the streaming refresh, on files made here."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from corpusgraph import engine, providers, schemas
from corpusgraph.functions import text as X
from corpusgraph.operators import evaluate, graph, incremental, inverted, ranking
from corpusgraph.plans import pipelines
from corpusgraph.sources import elements, manifest, parse, prompts
from corpusgraph.streaming import refresh


def one(source, kind="tree-sitter", path="rag/a/b.py"):
    return {e["name"].rsplit(".", 1)[-1]: e for e in parse.get_parser(kind)(source, path, "rag")}


def test_tree_rules():
    got = one('''
from rag.db import get, Store
from .x import near
import rag.io, json as j

@deco
class Büro(Store, a.b.C, Generic[T], metaclass=M):
    """About."""
    async def run(self): return self.x().close()
    @property
    def size(self): pass

async def work(a, b: int, *args, c=1, d, **kw):
    "Says 'hi'"
    def inner(): pass
    near(); Store.open(); Büro.run(); get(json.loads(x)).all(); log.info(1); print(len(a)); mod.Sub.f(); rag.io.read()

def two(): "a" "b"
''')
    assert list(got) == ["Büro", "work", "two"]
    c, f = got["Büro"], got["work"]
    assert (c["type"], c["docstring"], c["base_classes"], c["methods"]) == ("class", "About.", ["Store", "a.b.C"], ["run"])
    assert c["calls"] == ["close"] and c["code"].startswith("class Büro") and c["code"].endswith("pass")
    assert [p["name"] for p in f["parameters"]] == ["a", "d"] and f["is_async"] and f["docstring"] == "Says 'hi"
    assert f["calls"] == ["near", "rag.db.Store", "rag.a.b.Büro", "rag.db.get"]
    assert f["dependencies"] == ["rag.db.get", "rag.db.Store", "rag.io"]
    assert got["two"]["docstring"] == ""


def test_dotted_imports_resolve_by_their_first_part():
    got = one("import os\nfrom m import Big, low\ndef f():\n    os.path.join(); low.go(); Big.make(); Big.a.b(); XML.f(); thing.g()\n")
    assert got["f"]["calls"] == ["os.path.join", "m.low.go", "m.Big", "m.Big.a.b", "XML.f"]


def test_ast_rules():
    got = one('''
import rag.db as db
class A(x.y.Z, f().B):
    @staticmethod
    def m(self, q: Dict[str, int]) -> t.List[str]:
        v = go()
class B:
    class A:
        def n(self): pass
@deco(1)
@pkg.other
def outer(a, b: int = 2, *c, k: str) -> "X":
    first = one()
    def inner(): two()
    lost = three()
''', "ast")
    assert list(got) == ["A", "B", "inner", "outer"]
    assert got["A"]["base_classes"] == [] or got["A"]["base_classes"] == ["x.y.Z"]
    o = got["outer"]
    assert o["decorators"] == ["deco"] and o["return_type"] == "X" and o["parameters"] == [{"name": "a", "type": "Any", "default": None}, {"name": "b", "type": "int", "default": None}]
    assert o["calls"] == ["one"] and o["assignments"] == ["first"] and got["inner"]["calls"] == ["two"] and o["dependencies"] == ["rag.db"]
    rows = parse.parse_ast("class A:\n  def m(self): pass\nclass C:\n  class A:\n    def n(self): pass\n", "p.py")
    assert [r["methods"] for r in rows] == [["p.A.m", "p.A.n"], [], ["p.A.n"]]


def test_annotations():
    assert [parse.annotation(parse.ast.parse(s, mode="eval").body) for s in ("int", "Dict[str, int]", "a.b", "X | None", "List[a.B]", "None")] == ["int", "Dict[Any]", "a.b", "Any", "List[a.B]", "None"]
    assert [parse.module_of(p) for p in ("rag/a.py", "rag\\a\\b.py", "x", "a.pyc")] == ["rag.a", "rag.a.b", "x", "a.pyc"]
    with pytest.raises(ValueError, match="known"):
        parse.get_parser("lisp")


def test_bad_files_have_errors(spark):
    rows = [("a.py", "def f(:"), ("b.py", "def g(): pass"), ("c.py", None), ("d.py", ""), (None, "def h(): pass"), ("e.py", "x = '\0'")]
    got = {(r["file_path"], r["name"], r["error"] is None) for r in parse.parse_files(spark.createDataFrame(rows, "file_path string, source string")).collect()}
    assert got == {("a.py", None, False), ("b.py", "b.g", True), ("", ".h", True), ("e.py", None, False)}


def test_analyse_skips_what_is_done(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    (src / "pkg").mkdir(parents=True)
    (src / "pkg" / "a.py").write_text("def f(): pass\n")
    (src / "b.py").write_text("def g(:\n")
    (src / "no.txt").write_text("def x(): pass")
    assert elements.analyse(spark, str(src), cache) == {"files": 2, "failed": 1, "elements": 1}
    (src / "pkg" / "a.py").write_text("def f(): pass\ndef h(): pass\n")
    assert elements.main(["--root-dir", str(src), "--output-dir", cache, "--generate-explanations"]) == {"files": 2, "failed": 1, "elements": 2}
    assert elements.analyse(spark, str(src), cache) == {"files": 1, "failed": 1, "elements": 0}  # failed files come again
    (tmp_path / "cache" / "results_old").mkdir()
    (tmp_path / "cache" / "results_old" / "x.json").write_text(json.dumps({"type": "class", "name": "n", "calls": ["c"]}, indent=2))
    (tmp_path / "cache" / "results_old" / "progress.json").write_text("{}")
    (tmp_path / "cache" / "other.json").write_text("{}")
    got = elements.read_cache(spark, cache).where("error IS NULL").collect()
    assert sorted(r["name"] for r in got) == ["n", "pkg.a.f", "pkg.a.f", "pkg.a.h"]
    assert next(r for r in got if r["name"] == "n")["file_path"].endswith("x.json") and {r["explanation"] for r in got} == {None, "Explains pkg.a.f.", "Explains pkg.a.h."}
    nodes, edges = graph.build_graph(incremental.latest(elements.read_cache(spark, cache).where("error IS NULL").drop("error", "json_path"), "id", "explanation"), str(tmp_path / "g"))
    assert nodes.count() == 3 and edges.count() == 0 and schemas.violations(nodes).count() == 0 and schemas.populated(nodes)


def test_manifest_turns(spark, tmp_path):
    root, at, seen = tmp_path / "files", str(tmp_path / "manifest"), []
    root.mkdir()
    (root / "a.json").write_text("1")
    (root / "progress.json").write_text("1")
    index = lambda build, drop: seen.append((build.count(), drop.count()))
    run = lambda **k: manifest.build(spark, str(root), at, index, **k)
    assert run().mode == "cold" and run().mode == "unchanged" and seen == [(1, 0)]
    (root / "b.json").write_text("2")
    (root / "a.json").unlink()
    r = run()
    assert (r.mode, r.changed, r.removed) == ("refresh", 1, 1) and seen[-1] == (1, 1)
    assert run(signature=manifest.embed_signature(8)).changed == 1 and manifest.read(spark, at).signature == "8:cosine"
    assert run(signature="8:cosine", force=True).mode == "cold"
    assert manifest.read(spark, str(tmp_path / "none")).files.count() == 0


def test_diff_sees_nulls(spark):
    kind = "path string, mtime long, sha256 string"
    a = spark.createDataFrame([("p", 1, "x"), ("q", None, "x"), ("r", 1, None)], kind)
    b = spark.createDataFrame([("p", 1, None), ("q", 2, "x"), ("r", 1, None)], kind)
    assert {tuple(r) for r in incremental.snapshot_diff(a, b).collect()} == {("p", "changed"), ("q", "changed")}
    assert incremental.progress_totals(spark.createDataFrame([(5,)], "tokens long"), 0).first()["percent"] is None
    assert incremental.progress_eta(spark.createDataFrame([], "at timestamp"), 5).first()["remaining"] == 0


def test_vector_edges(spark):
    kind = "node_id long, embedding array<float>"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])], kind)
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], kind).toDF("query_id", "embedding")
    assert [tuple(r) for r in ranking.vector(v, q, 3).orderBy("rank").collect()] == [(7, 1, 1, 1.0), (7, 4, 2, 1.0), (7, 3, 3, 0.0)]
    assert ranking.vector(v.limit(0), q, 3).count() == 0 and ranking.vector(v, q.limit(0), 3).count() == 0
    for bad in ([1.0, 2.0, 3.0], [1.0, None]):
        with pytest.raises(Exception, match="numbers"):
            ranking.vector(v.unionByName(spark.createDataFrame([(9, bad)], kind)), q, 3).collect()


def test_search_in_parts(spark, monkeypatch):
    d = spark.createDataFrame([(i, " ".join(["ab"] * (i % 3 + 1) + [f"w{i % 5}"])) for i in range(60)], "node_id long, text string")
    q = spark.createDataFrame([(i, f"ab w{i % 5}") for i in range(40)] + [(99, "zz")], "query_id long, text string")
    rows = lambda: sorted(map(tuple, inverted.bm25(d, q, 4).collect()))
    whole = rows()
    monkeypatch.setattr(inverted, "BROADCAST", 0)
    assert rows() == whole and len(whole) == 160
    assert inverted.bm25(d, q, None).where("query_id = 1").count() == 60 and inverted.bm25(d.limit(0), q, 4).count() == 0


def test_pipelines_refuse_idle_options(spark):
    c = pipelines.Corpus(spark.createDataFrame([(1, "ab cd")], "node_id long, text string"))
    q = spark.createDataFrame([(1, "ab"), (2, None)], "query_id long, text string")
    with pytest.raises(ValueError, match="does not use cutoff"):
        pipelines.retrieve("bm25", c, q, cutoff=0.5)
    with pytest.raises(Exception, match="blank"):
        pipelines.retrieve("bm25", c, q, k=3).collect()


def test_prompts(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("id: p\ntemplate: |-\n  A {{ x }}\n  {% if y %}B {{ y }}{% endif %}\n  C\n")
    p = prompts.Prompts(str(tmp_path)).get("p")
    d = spark.createDataFrame([("1", "2"), (None, ""), ("{{ y }}", None)], "x string, y string")
    assert [r[0] for r in d.select(p.render({"x": F.col("x"), "y": F.col("y")})).collect()] == ["A 1\nB 2\nC", "A \nC", "A {{ y }}\nC"]
    (tmp_path / "q.yaml").write_text("id: p\ntemplate: x\n")
    with pytest.raises(ValueError, match="already"):
        prompts.Prompts(str(tmp_path))
    (tmp_path / "q.yaml").write_text("id: q\n")
    with pytest.raises(ValueError, match="needs"):
        prompts.Prompts(str(tmp_path))


def test_providers(spark):
    class Flaky:  # in here it travels to the workers by value
        n = 0

        def complete(self, prompt):
            self.n += 1
            if prompt == "bad" or self.n % 2:
                raise RuntimeError("busy")
            return prompt.upper()

    d = spark.createDataFrame([("ab",), ("bad",), (None,)], "prompt string").coalesce(1)
    got = {r["prompt"]: (r["answer"], r["answer_error"]) for r in providers.complete(d, Flaky(), tries=3, wait=0.0, concurrent=1).collect()}
    assert got == {"ab": ("AB", None), "bad": (None, "RuntimeError: busy"), None: (None, None)}
    with pytest.raises(NotImplementedError):
        providers.get_llm("openai")
    with pytest.raises(ValueError, match="known"):
        providers.get_embeddings("nope")
    v = providers.populate_embeddings(spark.createDataFrame([("a", "x y"), ("", "x"), (None, "x"), ("b", None)], "id string, text string"), providers.get_embeddings())
    assert [r["id"] for r in v.collect()] == ["a"]
    with pytest.raises(Exception, match="has not 3"):
        providers.checked_dimension(v, 3).collect()


def test_engine_and_server(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i} beta") for i in range(6)], "node_id long, text string")
    more = docs.select("node_id", F.lit("f").alias("file_path"), F.lit(None).cast("string").alias("element_type"), F.lit("").alias("element_name"), "text")
    e = engine.Engine(spark, pipelines.Corpus(docs), more, engine.Settings(pipeline="bm25", response_mode="odd"))
    assert e.settings.response_mode == "compact"
    row = e.retrieve(e.queries(["w3"]), k=2).first()
    assert (row["node_id"], row["element_type"], row["element_name"]) == (3, "unknown", "unknown")
    assert engine.process_query(e, "w3 alpha") == "Explains w3 alpha." and set(e.timings) == {"embedding", "retrieval", "synthesis", "total"}
    assert e.contexts(e.queries(["nothing"])).first()["stopped_reason"] == "no_candidates"
    with pytest.raises(engine.QueryProcessingError):
        e.queries([" "])
    assert engine.get_engine("x", lambda: e) is engine.get_engine("x", None)
    assert len(engine.setup_logging().handlers) == len(engine.setup_logging().handlers) == 1
    server = engine.serve(e, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{url}/health")) == {"status": "ok"}
        post = lambda body: urllib.request.urlopen(urllib.request.Request(f"{url}/query", json.dumps(body).encode(), method="POST"))
        assert json.load(post({"text": "w1"})) == {"response": "Explains w1."}
        for body, code in (({"text": ""}, 400), ([], 422)):
            with pytest.raises(urllib.error.HTTPError) as err:
                post(body)
            assert err.value.code == code
    finally:
        server.shutdown()
        server.server_close()


def test_text_rules(spark):
    d = spark.createDataFrame([("  a\n    b\n\n  c",), ("x",), ("",)], "t string")
    assert [r[0] for r in d.select(X.dedent(F.col("t"))).collect()] == ["a\n  b\n\nc", "x", ""]
    n = spark.createDataFrame([("n", "t"), ("unknown", "a\nName: z\nc"), ("unknown", "1\n2\n3\nName: z")], "name string, text string")
    assert [r[0] for r in n.select(X.eval_name(F.col("name"), F.col("text"))).collect()] == ["n", "z", None]


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a", "difficulty": "easy", "category": "c", "relevant_elements": ["x", "y", "x"]}], indent=1))
    q = evaluate.read_queries(spark, str(tmp_path / "q.json"))
    assert evaluate.qrels(q).count() == 2 and evaluate.count_by(q).first()["n"] == 1
    hits = q.select("query_id", F.lit("x").alias("node_id"), F.lit(1).alias("rank"))
    evaluate.write_report(evaluate.metrics(hits, q, evaluate.qrels(q).withColumnRenamed("element", "node_id")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/by_k"), header=True).count() == 6 and "k=1 precision=1.000" in spark.read.text(str(tmp_path / "out/summary")).orderBy("value").first()[0]


def test_streaming_refresh(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(): pass\n")
    out = str(tmp_path / "out")
    for _ in range(2):
        refresh.watch(spark, str(src), out, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        (src / "b.py").write_text("def g(): pass\ndef h(): pass\n")
    assert sorted(r["name"].rsplit(".", 1)[-1] for r in spark.read.parquet(out).collect()) == ["f", "g", "h"]
