"""Interaction of filters: what each removes in every order, and its Shapley share.

A document's failures are one bit a filter, so all orders follow from how many documents have which bits. These counts are
aggregated once; they form a removal polynomial for each part, the multilinear extension of "how many documents does a set
of filters remove".
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, UPPER

#: The contract's filters; bit i of a mask is the i-th letter.
FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint,"
    " good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the conditions A to D, which a text alone decides (never null)."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    chars, capitals = F.length(text).cast("long"), F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = (n < 100, 100 * distinct < 80 * n, 100 * capitals.cast("long") > 10 * chars, F.translate(text, SYMBOLS, "") != text)
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the rows of a part that fail exactly the filters of mask, and how many of them are labelled.

    Needs doc_id, text and lang of docs; doc_id, quality and toxic of labels; other columns are not read. A null text is
    empty, a null lang the part ''. A doc_id with several labels is good (toxic) if one of them says so; rows without a
    doc_id have no label, and are neither smaller nor larger than others. Repeated rows count each. No text is shuffled:
    equal texts meet by SHA-256, and copies are summed before, so that a text with any number of copies is at most four
    rows a part where its smallest doc_id is looked up.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), text_mask(text).alias("mask")
    )
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an id are dealt by their text, so they do not gather in one task of the join.
    rows = rows.withColumn("lone", F.when(F.col("id").isNull(), F.col("digest")).otherwise(""))
    said = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    rows = rows.join(marks.withColumn("lone", F.lit("")), ["id", "lone"], "left").fillna(False, ["good", "toxic"])
    named = F.col("id").isNotNull()
    texts = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(named, F.struct("id", "n"))).alias("least"), F.sum(F.when(named, F.lit(0)).otherwise(F.col("n"))).alias("nameless")
    )
    least = F.min("least.id").over(Window.partitionBy("digest"))
    first = F.col("nameless") + F.when(F.col("least.id") == least, F.col("least.n")).otherwise(F.lit(0))
    texts = texts.withColumn("first", first)
    both = F.array(F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    split = texts.select("part", "good", "toxic", F.explode(both).alias("m")).select("part", "good", "toxic", "m.mask", "m.n").filter("n > 0")
    counted = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(F.lit(0)))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic"))


class Removal:
    """The multilinear polynomial f(x) = sum over sets T of a[T] * prod of x_i for i in T, from counts of failure masks.

    A document failing the filters m is removed with the chance 1 - prod over i in m of (1 - x_i) when filter i is
    applied with the chance x_i; f is the sum over all documents. At a corner it is the number that a set of filters removes.
    """

    def __init__(self, counts: dict[int, int], filters: int):
        self.terms = {
            t: (1 if t.bit_count() % 2 else -1) * above
            for t in range(1, 1 << filters)
            if (above := sum(n for m, n in counts.items() if m & t == t))
        }

    def at(self, corner: int) -> int:
        return sum(a for t, a in self.terms.items() if t & corner == t)

    def partial(self, i: int) -> dict[int, int]:
        """The terms of the derivative by x_i."""
        return {t ^ (1 << i): a for t, a in self.terms.items() if t >> i & 1}

    def shapley(self, i: int) -> Fraction:
        """The integral of the derivative by x_i along the diagonal from 0 to 1: t^k gives 1 / (k + 1)."""
        return sum((Fraction(a, t.bit_count() + 1) for t, a in self.partial(i).items()), Fraction(0))


def orders(part: str, counts: dict[int, tuple[int, int, int]], filters: str) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, every step."""
    k = len(filters)
    every, good, toxic = (Removal({m: c[j] for m, c in counts.items()}, k) for j in range(3))
    corners = [tuple(f.at(s) for f in (every, good, toxic)) for s in range(1 << k)]
    total = sum(c[0] for c in counts.values())
    share = [int(every.shapley(i) * factorial(k)) for i in range(k)]
    alone = [sum(every.partial(i).values()) for i in range(k)]  # the derivative where all others are applied
    for order in permutations(range(k)):
        name, applied = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = applied | 1 << i
            removed, lost, gone = (b - a for a, b in zip(corners[applied], corners[now], strict=True))
            yield part, name, step, total - corners[now][0], removed, corners[1 << i][0] - removed, alone[i], lost, gone, share[i]
            applied = now


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The result of every order of the filters for each part of mask_counts(): k! * k rows a part, zeros included.

    kept: left after this step; removed: here; redundant: failing this filter but gone before; unique_fails: failing no
    other; good_lost, toxic_lost: labelled ones removed here; shapley: k! times this filter's Shapley share of the removals,
    which is a whole number. No documents give no rows. A part is one row of at most 2^k counts here.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def answered(batches):
        import pandas as pd

        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            for part, found in zip(batch["part"], batch["counts"], strict=True):
                rows = orders(part, {int(c["mask"]): (int(c["n"]), int(c["good"]), int(c["toxic"])) for c in found}, filters)
                yield pd.DataFrame(rows, columns=names)

    return parts.mapInPandas(answered, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's five filters on docs, in all 120 orders; see mask_counts() and audit()."""
    return audit(mask_counts(docs, labels))
