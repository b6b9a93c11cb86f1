"""The query facade: one configuration, one set of tables, named pipelines, timings."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers
from .operators import ranking
from .plans import pipelines

RESPONSE_MODES = ("compact", "refine", "tree_summarize", "simple_summarize", "no_text")


class AppError(Exception):
    """An error of this library."""


class QueryProcessingError(AppError):
    """A query that cannot be run."""


@dataclass(frozen=True)
class Settings:
    """All options in one place; nothing is read from the environment."""

    pipeline: str = "vector"
    top_k: int = 15
    response_mode: str = "compact"
    embedding: str = "offline"
    llm: str = "offline"
    dimension: int = 16
    metric: str = "cosine"
    adaptive: dict = field(default_factory=dict)

    def checked(self) -> Settings:
        """With a known response mode (an unknown one falls back to compact); an unknown pipeline or metric is an error."""
        pipelines.get(self.pipeline)
        if self.metric not in ranking.METRICS:
            raise ValueError(f"unknown metric {self.metric!r}; known: {', '.join(ranking.METRICS)}")
        mode = self.response_mode.lower()
        return replace(self, response_mode=mode if mode in RESPONSE_MODES else "compact")


def setup_logging(level: int = logging.INFO) -> logging.Logger:
    """The library's logger with one handler, however often this is called."""
    log = logging.getLogger("corpusgraph")
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    log.setLevel(level)
    return log


@dataclass
class Engine:
    """Pipelines over a corpus. `elements`: node_id, file_path, element_type, element_name, text."""

    spark: SparkSession
    corpus: pipelines.Corpus
    elements: DataFrame
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self):
        self.settings = self.settings.checked()
        self.corpus = replace(self.corpus, metric=self.settings.metric)
        self.timings: dict[str, float] = {}

    def queries(self, texts: list[str]) -> DataFrame:
        """Numbered queries with their vectors; blank ones are an error."""
        if not texts or any(not (t or "").strip() for t in texts):
            raise QueryProcessingError("a query is blank")
        embed = providers.get_embeddings(self.settings.embedding, dimension=self.settings.dimension).embed(texts)
        rows = [(i, t, [float(x) for x in e]) for i, (t, e) in enumerate(zip(texts, embed, strict=True))]
        return self.spark.createDataFrame(rows, "query_id long, text string, embedding array<float>")

    def retrieve(self, queries: DataFrame, k: int = 10, **options) -> DataFrame:
        """The hits of the configured pipeline with their metadata, without a language model and without adaptive selection."""
        hits = pipelines.retrieve(self.settings.pipeline, self.corpus, queries, k=k, **options)
        return pipelines.results(hits.where(F.col("rank") <= k), self.elements)

    def contexts(self, queries: DataFrame, **options) -> DataFrame:
        """(query_id, prompt, selected_k, stopped_reason): adaptively selected texts by rank, joined to one prompt a query."""
        hits = pipelines.retrieve(self.settings.pipeline, self.corpus, queries, k=self.settings.top_k, **options)
        texts = self.elements.select("node_id", F.coalesce("text", F.lit("")).alias("text"))
        return context(hits.join(texts, "node_id"), queries, **self.settings.adaptive)

    def answer(self, texts: list[str], **options) -> list[dict]:
        """Answers of the language model to a list of queries; seconds by step go to `timings`."""
        began = time.perf_counter()
        q = self.queries(texts)
        self.timings = {"embedding": time.perf_counter() - began}
        began = time.perf_counter()
        told = self.contexts(q, **options).persist()
        try:
            told.count()
            self.timings["retrieval"] = time.perf_counter() - began
            began = time.perf_counter()
            if self.settings.response_mode == "no_text":
                said = told.withColumns({"answer": F.lit(None).cast("string"), "answer_error": F.lit(None).cast("string")})
            else:
                said = providers.complete(told, providers.get_llm(self.settings.llm))
            rows = [r.asDict() for r in said.orderBy("query_id").collect()]  # one for each query in the list
            self.timings["synthesis"] = time.perf_counter() - began
        finally:
            told.unpersist()
        self.timings["total"] = sum(self.timings.values())
        return rows


def context(hits: DataFrame, queries: DataFrame, **adaptive) -> DataFrame:
    """One prompt a query from hits with their texts; queries without hits have an empty context and the reason no_candidates."""
    lengths = hits.withColumn("chars", F.length("text"))
    chosen = ranking.adaptive_k(lengths, queries=queries, **adaptive).select("query_id", "selected_k", "stopped_reason")
    kept = hits.join(chosen, "query_id").where(F.col("rank") <= F.col("selected_k"))
    # At most top_k texts a query.
    body = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x")).select("query_id", F.array_join("x.text", "\n\n").alias("context"))
    made = queries.select("query_id", "text").join(chosen, "query_id").join(body, "query_id", "left")
    prompt = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nName: "), F.col("text"), F.lit("\nAnswer from the context alone."))
    return made.select("query_id", prompt.alias("prompt"), "selected_k", "stopped_reason")


_engines: dict[str, Engine] = {}


def get_engine(name: str, make) -> Engine:
    """The session's engine of that name; `make` builds it once. A failed build leaves nothing behind."""
    if name not in _engines:
        _engines[name] = make()
    return _engines[name]


def process_query(engine: Engine, text: str) -> str:
    """The answer to one query as text."""
    row = engine.answer([text])[0]
    if row["answer_error"]:
        raise QueryProcessingError(row["answer_error"])
    return row["answer"] or ""


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000):
    """A small HTTP server: GET /health, POST /query {"text": ...}; a blank query is 400. Returns the server, not yet running."""
    import json
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.reply(200, {"status": "ok"}) if self.path in ("/", "/health") else self.reply(404, {"detail": "not found"})

        def do_POST(self):
            if self.path != "/query":
                return self.reply(404, {"detail": "not found"})
            try:
                text = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0)))).get("text")
            except (ValueError, AttributeError):
                return self.reply(422, {"detail": "the body must be a JSON object"})
            try:
                self.reply(200, {"response": process_query(engine, text or "")})
            except QueryProcessingError as e:
                self.reply(400, {"detail": str(e)})

        def log_message(self, *args):
            logging.getLogger("corpusgraph").debug(*args)

    return ThreadingHTTPServer((host, port), Handler)
