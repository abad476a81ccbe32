"""Structure-aware chunking, chunk embeddings and the incremental index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 900, 150
SEPARATOR = " › "
#: Characters that may end a piece of a long block.
ENDS = "。！？；.!?;\n"


def blocks(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, body, start, end): fences, headings, tables, lists, quotes and paragraphs of a Markdown text."""
    at, lines = 0, text.splitlines(keepends=True)
    spans = []
    for line in lines:
        spans.append((line, at))
        at += len(line)
    i = 0
    while i < len(spans):
        line, start = spans[i]
        bare = line.strip()
        if not bare:
            i += 1
            continue
        kind, j = kind_of(line), i + 1
        if kind == "fence":
            mark = bare[:3]
            while j < len(spans) and not spans[j][0].strip().startswith(mark):
                j += 1
            j = min(j + 1, len(spans))
        elif kind != "heading":
            while j < len(spans) and spans[j][0].strip() and (kind_of(spans[j][0]) == kind or kind == "list" and spans[j][0][:1] in " \t"):
                j += 1
        end = spans[j - 1][1] + len(spans[j - 1][0].rstrip("\n"))
        yield kind, text[start:end], start, end
        i = j


def kind_of(line: str) -> str:
    bare = line.strip()
    if bare.startswith(("```", "~~~")):
        return "fence"
    if re.match(r"#{1,6}\s", bare):
        return "heading"
    if bare.startswith("|"):
        return "table"
    if re.match(r"([-*+]|\d+[.)])\s", bare):
        return "list"
    return "quote" if bare.startswith(">") else "paragraph"


def split_sentences(text: str, most: int, overlap: int = 0) -> list[str]:
    """Pieces of at most `most` characters, cut after the last sentence end that fits, else hard; the next begins `overlap` earlier."""
    pieces, at = [], 0
    while at < len(text):
        if len(text) - at <= most:
            pieces.append(text[at:])
            break
        window = text[at : at + most]
        cut = max(window.rfind(c) for c in ENDS) + 1 or most
        pieces.append(window[:cut])
        at = max(at + 1, at + cut - overlap)
    return [p for p in (p.strip() for p in pieces) if p]


def tail(text: str, most: int) -> str:
    """The last whole sentences within `most` characters."""
    if len(text) <= most:
        return text
    part = text[-most:]
    starts = [part.find(c) for c in ENDS if 0 <= part.find(c) < len(part) - 1]
    return part[min(starts) + 1 :].strip() if starts else part


def chunk(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """ord, heading (its path), content, char_start, char_end of each chunk.

    Fences, tables and lists are never split. A section begins afresh: nothing of the section before leaks into it.
    A tail under a quarter of the size joins the chunk before it, if that has the same heading.
    """
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    held: list[tuple[str, str, int, int]] = []

    def heading() -> str:
        return SEPARATOR.join(t for _, t in path)

    def add(content: str, start: int, end: int) -> None:
        if out and len(content) < size // 4 and out[-1]["heading"] == heading() and len(out[-1]["content"]) + len(content) < 1.25 * size:
            out[-1]["content"] += "\n\n" + content
            out[-1]["char_end"] = end
        elif content.strip():
            out.append({"heading": heading(), "content": content, "char_start": start, "char_end": end})

    def flush(carry: bool) -> None:
        if not held:
            return
        add("\n\n".join(b for _, b, _, _ in held), held[0][2], held[-1][3])
        kind, body, _, end = held[-1]
        held.clear()
        if carry and kind == "paragraph" and len(body) > overlap:
            rest = tail(body, overlap)
            if rest and rest != body:
                held.append(("carry", rest, end - len(rest), end))

    for kind, body, start, end in blocks(text or ""):
        if kind == "heading":
            drop_carry(held)
            flush(False)
            level = len(body) - len(body.lstrip("#"))
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, body.lstrip("#").strip()))
            continue
        atomic = kind in ("fence", "table", "list")
        if len(body) > size and not atomic:
            drop_carry(held)
            flush(False)
            at = start
            for piece in split_sentences(body, size, overlap):
                found = (text or "").find(piece, max(start, at - overlap - 1), end)
                at = (found if found >= 0 else at) + len(piece)
                add(piece, at - len(piece), at)
            continue
        if held and sum(len(b) + 2 for _, b, _, _ in held) + len(body) > size:
            flush(not atomic)
        held.append((kind, body, start, end))
    drop_carry(held)
    flush(False)
    return [{"ord": i, **c} for i, c in enumerate(out)]


def drop_carry(held: list) -> None:
    """A carried tail alone is no chunk."""
    if len(held) == 1 and held[0][0] == "carry":
        held.clear()


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc, ord, heading, content, char_start, char_end of every document (id, content); a null content has no chunks."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *c.values()) for i, text in zip(part["id"], part["content"], strict=True) for c in chunk(text, size, overlap)]
            yield pd.DataFrame(rows, columns=["doc", "ord", "heading", "content", "char_start", "char_end"])

    return docs.select("id", "content").mapInPandas(work, "doc long, ord int, heading string, content string, char_start int, char_end int")


def context_needed(text: Column, chunks: Column) -> Column:
    """Whether a document's chunks need context of their own: it has several, and headings for fewer than half of them."""
    headings = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^#{1,6}\s"), F.lit(0)))
    return (chunks > 1) & (headings < 0.5 * chunks)


def embed_text(chunks: DataFrame) -> DataFrame:
    """What is embedded of a chunk: its heading path, a blank line and the content."""
    head = F.when(F.col("heading") != "", F.concat("heading", F.lit("\n\n"))).otherwise("")
    return chunks.withColumn("embed_text", F.concat(head, F.col("content")))


def rebuild(chunks: DataFrame) -> DataFrame:
    """doc, content: a document's chunks joined by blank lines."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"])
    return chunks.groupBy("doc").agg(F.array_join(parts, "\n\n").alias("content"))


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 2166136261
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def embed_tokens(text: str) -> list[str]:
    """Latin words (and the parts of long ones), and CJK pairs and triples."""
    found = []
    for w in re.findall(r"[a-z0-9][a-z0-9_./-]+", text.lower()):
        found.append(w)
        if len(w) > 6:
            found += [p for p in re.split(r"[_./-]", w) if len(p) > 2]
    for run in re.findall("[一-鿿぀-ヿ]{2,}", text):
        found += [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
    return found


@lru_cache(maxsize=1 << 17)
def places(token: str) -> tuple[tuple[int, float], ...]:
    """The hash of a token and its share, twice; words come again in most texts."""
    return tuple((fnv1a(token + salt), share) for salt, share in (("", 1.0), ("#2", 0.5)))


def hash_vector(text: str | None, dims: int = 384, chars: int | None = None) -> list[float]:
    """Feature hashing: each token adds 1 + ln(tf) in one signed dimension and half of it in another; not yet of unit length.

    White space counts as one space; `chars` cuts the text (a store that embeds only beginnings has 4000), None takes it whole.
    """
    v = [0.0] * dims
    for token, n in Counter(embed_tokens(re.sub(r"\s+", " ", text or "").strip()[:chars])).items():
        w = 1 + math.log(n)
        for h, share in places(token):
            v[h % dims] += share * w * (1 if h & 1 else -1)
    return v


def hash_embed(rows: DataFrame, column: str = "content", dims: int = 384, chars: int | None = None) -> DataFrame:
    """id, embedding by hash_vector, for stores without a model; vectors are brought to unit length when they are stored."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "embedding": [hash_vector(t, dims, chars) for t in part["text"]]})

    return rows.select("id", F.col(column).alias("text")).mapInPandas(work, "id long, embedding array<float>")
