"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger holds the measurements and one failure bit a rule. Policies
are versioned masks over these bits, applied later and as often as wanted, and ablations are bitwise aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, free, stored, without

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
#: Repeated windows of a text up to which each position is looked up in a list; beyond, positions are sorted.
FEW = 16
MEASURES = ("n_words", "word_chars", "n_symbols", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements, in SQL with integers only."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_words", "n_words > 1000000"),
    Rule(3, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(4, "long_words", "word_chars > 12 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > n_words"),
    Rule(6, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(7, "digits", "5 * n_digits > word_chars"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    mask: int


POLICIES = (Policy("base", 1, BASE), Policy("web", 1, 0b0111_1111), Policy("web", 2, 0b1111_1111), Policy("web", 3, 0b1111_1011))
#: Since version 3 size alone rejects nothing: many_words is measured only.
CURRENT = POLICIES[-1]


def removed(text: str, chars: str) -> Column:
    """How many characters of `chars` the text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and MEASURES, all computed within the row."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    rows = docs.withColumn("__lk_text", trimmed)
    rows = rows.withColumns({
        "__lk_words": F.when(F.col("__lk_text") == "", F.array().cast("array<string>")).otherwise(F.split("__lk_text", SPACE_RUN)),
        "__lk_lines": F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
    })
    rows = rows.withColumn("__lk_windows", F.expr(
        "CASE WHEN size(__lk_words) < 3 THEN cast(array() AS array<bigint>)"
        " ELSE transform(sequence(0, size(__lk_words) - 3), i -> xxhash64(__lk_words[i], __lk_words[i + 1], __lk_words[i + 2])) END"
    ))
    rows = rows.withColumn("__lk_sorted", F.sort_array("__lk_windows"))
    rows = rows.withColumn("__lk_twice", F.expr(
        "CASE WHEN size(array_distinct(__lk_windows)) = size(__lk_windows) THEN cast(array() AS array<bigint>)"
        " ELSE array_distinct(filter(__lk_sorted, (h, i) -> i > 0 AND h = get(__lk_sorted, i - 1))) END"
    ))
    rows = rows.withColumn("__lk_placed", F.expr(
        f"CASE WHEN size(__lk_twice) > {FEW} THEN sort_array(transform(__lk_windows, (h, i) -> struct(h, i))) END"
    ))
    rows = rows.withColumn("__lk_at", F.expr(
        "CASE WHEN size(__lk_twice) = 0 THEN cast(array() AS array<int>)"
        f" WHEN size(__lk_twice) <= {FEW} THEN filter(sequence(0, size(__lk_windows) - 1), i -> array_contains(__lk_twice, __lk_windows[i]))"
        " ELSE transform(filter(__lk_placed, (x, i) -> x.h <=> get(__lk_placed, i - 1).h OR x.h <=> get(__lk_placed, i + 1).h), x -> x.i) END"
    ))
    return rows.select(
        *[F.col(c) for c in docs.columns],
        F.size("__lk_words").cast("long").alias("n_words"),
        F.length(F.translate("__lk_text", SPACES, "")).cast("long").alias("word_chars"),
        removed("__lk_text", SYMBOLS).alias("n_symbols"),
        removed("__lk_text", DIGITS).alias("n_digits"),
        F.size("__lk_lines").cast("long").alias("n_lines"),
        (F.size("__lk_lines") - F.size(F.array_distinct("__lk_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(concat(__lk_at, transform(__lk_at, i -> i + 1), transform(__lk_at, i -> i + 2)))) AS bigint)").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, MEASURES and fail_bits (bit r is set if rule r fails); one pass, no shuffle.

    Words are runs of characters other than space and \\t..\\r. n_repeat_words counts the words that lie in a 3-word
    window found twice or more (windows are told apart by 64-bit hash). Null, empty and blank texts have no words, so
    all their measures are 0. Input columns with a name of the ledger are replaced, others pass through; repeated
    rows stay repeated, and an empty table gives an empty one. Texts are measured whole.
    """
    docs = without(docs, *MEASURES, "fail_bits")
    clashing = [c for c in docs.columns if c.lower().startswith("__lk_")]
    aside = dict(zip(clashing, free(docs, *[f"aside{i}" for i in range(len(clashing))]), strict=True))
    back = {v: k for k, v in aside.items()}
    bits = " | ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END" for r in rules)
    return measured(docs.withColumnsRenamed(aside)).withColumn("fail_bits", F.expr(bits)).withColumnsRenamed(back)


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def recorded(docs: DataFrame) -> DataFrame:
    """The ledger of docs without their texts, as a stored table that any number of policies and ablations read."""
    return stored(ledger(docs).drop("text"), "quality-ledger")


def verdicts(ledgered: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept (no rule of the policy nor of the base fails), from the bits alone."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return without(ledgered, "base_failed", "kept").withColumns({"base_failed": failed, "kept": ~failed & passes(policy)})


def judge(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The verdicts of one policy on docs in a single pass; recorded() is the way to judge more than once."""
    return verdicts(ledger(without(docs, "base_failed", "kept")), policy)


def accepted(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with their columns.

    A filter on `kept` alone would be pushed below the ledger with every measure written out in its condition, and each
    would be computed again wherever the condition names it. The row number holds the filter above the ledger.
    """
    (number,) = free(docs, "number")
    judged = judge(docs, policy).withColumn(number, F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col(number) >= 0)).select(*docs.columns)


def ablations(ledgered: DataFrame, policy: Policy = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a rule: rows, failed, only (rows that this rule alone rejects; none if the policy lacks it), kept, kept_without.

    A single aggregation over the bits; no rule is evaluated again.
    """
    inside = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(inside == 0).alias("kept")]
    for r in rules:
        sums += [F.count_if(F.col("fail_bits").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}"), F.count_if(inside == (1 << r.bit)).alias(f"o{r.bit}")]
    total = ledgered.agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.lit(r.name).alias("rule"), F.col("n").alias("n_rows"),
                 F.col(f"f{r.bit}").alias("failed"), F.col(f"o{r.bit}").alias("only"), F.col("kept"), (F.col("kept") + F.col(f"o{r.bit}")).alias("kept_without"))
        for r in rules
    ])
    return total.select(F.explode(rows).alias("r")).select("r.*")
