"""Models behind protocols: embedders with backfill, and extraction by a language model with recovery of its JSON.

A model is made by a factory once in each Python worker and then fed batch by batch; where it fails, rules or hashing serve.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .documents import hash_vector
from .extraction import extract, normalized
from .mutations import delete_memories

#: Texts that a model gets at a time, and memories that a session may give.
BATCH, MOST = 64, 12
FENCED = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)
MADE: dict[str, object] = {}
RAW = "title string, content string, kind string, sensitivity string, tags array<string>, confidence double, importance double"


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float] | None]: ...


class LanguageModel(Protocol):
    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def made(name: str, factory: Callable):
    """The worker's own model of a name; the factory runs once a worker."""
    if name not in MADE:
        MADE[name] = factory()
    return MADE[name]


def batches(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def embedded(rows: DataFrame, name: str, factory: Callable[[], Embedder], batch: int = BATCH, dims: int = 384) -> DataFrame:
    """id, embedding, model of rows (id, content): by the model, or by hashing (model hash:<dims>) where it fails or gives nothing."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: list[list[float] | None] = []
            for texts in batches([t or "" for t in part["content"]], batch):
                try:
                    got = list(made(name, factory)(texts))
                except Exception:  # noqa: BLE001 - whatever a model raises, the texts are embedded otherwise
                    got = []
                found += [got[i] if i < len(got) else None for i in range(len(texts))]
            out = [(v, name) if v is not None else (hash_vector(t, dims), f"hash:{dims}") for v, t in zip(found, part["content"], strict=True)]
            yield pd.DataFrame({"id": part["id"], "embedding": [[float(x) for x in v] for v, _ in out], "model": [m for _, m in out]})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "content").mapInPandas(work, f"id {kind}, embedding array<float>, model string")


def lacking(memories: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Memories, active or pending and not secret, without a vector of the model."""
    have = vectors.filter(F.col("model") == model).select("id")
    return memories.filter("status in ('active', 'pending') and sensitivity <> 'secret'").join(have, "id", "left_anti")


def backfilled(memories: DataFrame, vectors: DataFrame, name: str, factory: Callable[[], Embedder], batch: int = BATCH) -> DataFrame:
    """vectors (id, embedding, model) with one of the model for every memory that lacks it; what the model fails on stays lacking."""
    texts = lacking(memories, vectors, name).select("id", F.concat_ws("\n", "title", "content").alias("content"))
    new = embedded(texts, name, factory, batch).filter(F.col("model") == name)
    return vectors.select("id", "embedding", "model").unionByName(new)


def balanced(text: str) -> str | None:
    """The first { or [ with all up to its closing partner; brackets in strings do not count."""
    start = next((i for i, c in enumerate(text) if c in "{["), None)
    if start is None:
        return None
    open_, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None
            if not open_:
                return text[start : i + 1]
    return None


def recovered(text: str | None):
    """The JSON value in a model's answer: the whole answer, else what is fenced, else the first balanced bracket; None without one."""
    for found in (text, *FENCED.findall(text or ""), balanced(text or "")):
        try:
            if found and isinstance(value := json.loads(found.strip()), (dict, list)):
                return value
        except ValueError:
            continue
    return None


def memories_in(answer: str | None) -> list[dict] | None:
    """The memories of an answer ([...] or {"memories": [...]}), None where it has no such JSON."""
    value = recovered(answer)
    if isinstance(value, dict):
        value = value.get("memories")
    if not isinstance(value, list):
        return None
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    word = lambda x: x if isinstance(x, str) else None
    rows = [x for x in value if isinstance(x, dict)]
    return [
        {"title": word(x.get("title")), "content": word(x.get("content")), "kind": word(x.get("kind")), "sensitivity": word(x.get("sensitivity")),
         "tags": [t for t in x.get("tags") or [] if isinstance(t, str)] if isinstance(x.get("tags") or [], list) else [], "confidence": number(x.get("confidence")), "importance": number(x.get("importance"))}
        for x in rows
    ]


def model_extract(turns: DataFrame, name: str, factory: Callable[[], LanguageModel], prompt: str = "{transcript}", kinds: tuple[str, ...] = ("fact",), chars: int = 24_000, most: int = MOST, batch: int = 8) -> DataFrame:
    """conv_id, method (model or rules), kind, title, content, sensitivity, confidence, importance, tags of each session.

    A session's transcript (its last `chars` characters) goes to the model; of its answer the first `most` well-formed
    memories count. Sessions whose answer holds no JSON, or on which the model fails, are extracted by rules.
    """
    said = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    sessions = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))), lambda t: t["said"]), "\n").alias("transcript"))
    sessions = sessions.withColumn("transcript", F.right("transcript", F.lit(chars)))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for rows in batches(list(zip(part["conv_id"], part["transcript"], strict=True)), batch):
                try:
                    answers = list(made(name, factory)([prompt.replace("{transcript}", t) for _, t in rows]))
                except Exception:  # noqa: BLE001 - whatever a model raises, rules serve
                    answers = []
                for i, (conv, _) in enumerate(rows):
                    found = memories_in(answers[i] if i < len(answers) else None)
                    out.append((conv, found is not None, found or []))
            yield pd.DataFrame(out, columns=["conv_id", "answered", "found"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = ", ".join(x.replace(" ", ":", 1) for x in RAW.split(", "))
    asked = sessions.mapInPandas(work, f"conv_id {kind}, answered boolean, found array<struct<{fields}>>")
    asked = stored(asked, "model-answers")  # a model is asked once
    raw = asked.select("conv_id", F.posexplode("found").alias("place", "m")).select("conv_id", "place", "m.*")
    good = normalized(raw, kinds).filter("trim(content) <> ''")
    good = good.withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy("place"))).filter(F.col("nth") <= most)
    columns = ["conv_id", "method", "kind", "title", "content", "sensitivity", "confidence", "importance", "tags"]
    by_rules = extract(turns.join(asked.filter("not answered").select("conv_id"), "conv_id", "left_semi"))
    return good.withColumn("method", F.lit("model")).select(*columns).unionByName(by_rules.withColumns({"method": F.lit("rules"), "tags": F.array("tag")}).select(*columns))


def harvest(docs: DataFrame, memories: DataFrame, name: str, factory: Callable[[], LanguageModel], prompt: str = "{transcript}", kinds: tuple[str, ...] = ("fact",), chars: int = 8000) -> DataFrame:
    """Pending memories (doc, kind, title, content, sensitivity, confidence, importance, tags, status) that a model finds in documents.

    A document's first `chars` characters go to the model (that is the feature: one question a document). A title that a
    memory has already, or that another document gave first, is passed over; a document on which the model fails gives none.
    """
    texts = docs.select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("document").alias("role"), F.left(F.coalesce("content", F.lit("")), F.lit(chars)).alias("text"))
    found = model_extract(texts, name, factory, prompt, kinds, chars + 16).filter("method = 'model'")
    new = found.join(memories.select(F.lower(F.trim("title")).alias("known")).distinct(), F.lower(F.trim("title")) == F.col("known"), "left_anti")
    nth = F.row_number().over(W.partitionBy(F.lower(F.trim("title"))).orderBy("conv_id"))
    return new.withColumn("nth", nth).filter("nth = 1").drop("nth", "method").withColumnRenamed("conv_id", "doc").withColumn("status", F.lit("pending"))


def maintained(tables: dict[str, DataFrame], now: str, name: str, factory: Callable[[], Embedder]) -> dict[str, DataFrame]:
    """A day's upkeep: memories that have expired (expires_at before now, not pinned) go with all that hangs on them, vectors that lack are made."""
    expired = tables["memories"].filter((F.col("expires_at") < F.lit(now).cast("timestamp")) & ~F.coalesce("pinned", F.lit(False)))
    left = tables | delete_memories({k: tables[k] for k in ("memories", "vectors", "links", "edges")}, expired.select("id"))
    return left | {"vectors": backfilled(left["memories"], left["vectors"], name, factory)}
