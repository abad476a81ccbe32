"""Scalar functions of the store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def normalize_tag(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, "_", "-")))


def tag_ancestors(tag: Column) -> Column:
    """a/b/c -> [a, a/b, a/b/c]."""
    parts = F.split(tag, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normalize_key(c: Column) -> Column:
    """Identity of an entity: lower case without white space."""
    return F.regexp_replace(F.lower(F.trim(c)), "\\s+", "")


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in columns]), 256)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def logistic_rank(rank: Column) -> Column:
    """Score of a bm25 rank (negative is better)."""
    return 1 / (1 + F.exp(rank / 4))


def reciprocal_rank(rank: Column) -> Column:
    """The chunk search's score; a better rank gets a smaller one, as in the original."""
    return 1 / (1 + F.abs(rank))


def recency(created: Column, now_ms: int) -> Column:
    age = (F.lit(now_ms) - F.unix_millis(created.cast("timestamp"))) / DAY_MS
    return 0.15 * F.exp(-F.greatest(age, F.lit(0.0)) / 60)


def weight_importance(importance: Column, pinned: Column) -> Column:
    return 0.2 * importance + F.when(pinned, 0.25).otherwise(0.0)


def heat_level(count: Column) -> Column:
    return F.when(count == 0, 0).when(count <= 2, 1).when(count <= 5, 2).when(count <= 9, 3).otherwise(4)


def week_start(ts: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def snippet(text: Column, terms: list[str], before: int = 50, after: int = 110, whole: int = 160) -> Column:
    """A window around the first term of two characters or more, its terms marked; else the beginning."""
    used = [t for t in terms if len(t) >= 2]
    low = F.lower(text)
    at = F.coalesce(*[F.nullif(F.instr(low, t.lower()), F.lit(0)) for t in used], F.lit(0)) if used else F.lit(0)
    start = F.greatest(at - before, F.lit(1))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(before + after)), F.when(start + before + after - 1 < F.length(text), "…").otherwise(""))
    for t in used:
        quoted = "".join("\\" + c if not c.isalnum() else c for c in t)
        cut = F.regexp_replace(cut, f"(?i)({quoted})", "<mark>$1</mark>")
    return F.when(at > 0, cut).otherwise(F.left(text, F.lit(whole)))


def mask_preview(c: Column) -> Column:
    return F.when(F.length(c) <= 10, "****").otherwise(F.concat(F.left(c, F.lit(6)), F.lit("****"), F.right(c, F.lit(4))))


def slug(c: Column, most: int = 60) -> Column:
    clean = F.regexp_replace(F.trim(c), "[\\\\/:*?\"<>|#]", "")
    return F.left(F.regexp_replace(clean, "\\s+", "-"), F.lit(most))


def document_title(text: Column, stem: Column) -> Column:
    """Title of the front matter, else the first level-one heading, else the file's stem."""
    front = F.regexp_extract(text, r"(?s)^---\n.*?\btitle:[ \t]*([^\n]+)\n.*?---", 1)
    head = F.regexp_extract(text, r"(?m)^# +(.+)$", 1)
    return F.coalesce(F.nullif(F.trim(front), F.lit("")), F.nullif(F.trim(head), F.lit("")), stem)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the characters of the basic plane."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
