"""Embedding and language-model providers: an interface, a registry, and offline ones that need no network.

Providers travel with their tasks, so they must be picklable; a remote one opens its connection on first use.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X
from .sources.prompts import Prompts


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Llm(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashEmbedder:
    """Offline stand-in: each distinct word adds 1 to the place that the first 4 hex digits of its MD5 name, modulo the dimension."""

    def __init__(self, dimension: int = 16):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import regex

        word = regex.compile(X.TOKEN)
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for w in set(word.findall(text.lower())):
                row[int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:4], 16) % self.dimension] += 1
        return out.tolist()


class Echo:
    """Offline stand-in for a language model: the prompt's `Name:` line, said as a sentence."""

    def complete(self, prompt: str) -> str:
        named = next((x[6:] for x in prompt.splitlines() if x.startswith("Name: ")), "")
        return f"Explains {named}." if named else ""


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"offline": HashEmbedder}
LLMS: dict[str, Callable[..., Llm]] = {"offline": Echo}
#: Names of services that need a client library and a key; they are registered by whoever has both.
REMOTE_EMBEDDERS = ("voyage", "voyage-large", "voyage-lite", "openai")
REMOTE_LLMS = ("anthropic", "openai")


def _register(known: dict, name: str):
    def put(make):
        if known.get(name, make) is not make:
            raise ValueError(f"provider {name!r} is registered already")
        known[name] = make
        return make

    return put


def register_embedding(name: str):
    """Register a maker of embedders; a name that stands for another one is an error."""
    return _register(EMBEDDERS, name)


def register_llm(name: str):
    return _register(LLMS, name)


def _get(known: dict, remote: tuple[str, ...], name: str, options: dict):
    name = name.strip()
    if name in known:
        return known[name](**options)
    if name in remote:
        raise NotImplementedError(f"provider {name!r} is not bundled; register it first")
    raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(known))}")


def get_embeddings(name: str = "offline", **options) -> Embedder:
    return _get(EMBEDDERS, REMOTE_EMBEDDERS, name, options)


def get_llm(name: str = "offline", **options) -> Llm:
    return _get(LLMS, REMOTE_LLMS, name, options)


def embedding(text: Column, provider: Embedder) -> Column:
    """The vectors of a text column, one call a batch; a null text counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(provider.embed([x or "" for x in s]), dtype=object)

    return run(text)


def populate_embeddings(docs: DataFrame, provider: Embedder, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, embedding) of documents that have a key and a text."""
    ready = docs.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(text).isNotNull())
    return ready.select(key, embedding(F.col(text), provider).alias("embedding"))


def checked_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """The same rows; the job fails at a vector of another length."""
    ok = F.size(column) == dimension
    return vectors.withColumn(column, F.when(ok | F.col(column).isNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a vector has not {dimension} numbers but "), F.size(column))).cast(vectors.schema[column].dataType)))


def complete(prompts: DataFrame, provider: Llm, *, column: str = "prompt", out: str = "answer", tries: int = 5, wait: float = 0.5, concurrent: int | None = None) -> DataFrame:
    """Answers to a column of prompts, with `<out>_error` where every try failed; waits double from try to try.

    concurrent: at most so many calls at a time, one for each partition. Prompts are dealt out anew for that, so what makes them keeps its own
    tasks.
    """
    rows = prompts if concurrent is None else prompts.repartition(concurrent)

    @F.pandas_udf(f"{out} string, {out}_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            told = []
            for p in s:
                said, why = None, None
                for turn in range(tries if p is not None else 0):
                    try:
                        said, why = provider.complete(p), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a client raises is the row's error
                        why = f"{type(e).__name__}: {e}"
                        if turn + 1 < tries:
                            time.sleep(wait * 2**turn * (1 + random.random() / 4))
                told.append((said, why))
            yield pd.DataFrame(told, columns=[out, f"{out}_error"], dtype=object)

    return rows.withColumn("_told", run(F.col(column))).select("*", "_told.*").drop("_told")


def explain(elements: DataFrame, provider: Llm, *, concurrent: int | None = None, **options) -> DataFrame:
    """Elements with explanations by the model; where it fails the former one stays."""
    p = Prompts().get("explain")
    lists = {f.name for f in elements.schema.fields if isinstance(f.dataType, T.ArrayType)}
    values = {n: F.array_join(n, ", ") if n in lists else F.col(n) for n in p.names() if n != "parameters"} | {"parameters": X.format_parameters(F.col("parameters"))}
    told = complete(elements.withColumn("_prompt", p.render(values)), provider, column="_prompt", out="_said", concurrent=concurrent, **options)
    return told.withColumn("explanation", F.coalesce(X.filled(F.col("_said")), F.col("explanation"))).select(*elements.columns)
