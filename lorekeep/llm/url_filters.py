"""URL allow and block rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hexadecimal digits of a digest that the rows are joined on; the full digest is compared afterwards.
SHORT = 8
#: Rules that are broadcast at most; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict ('allow' or 'block') as a frame."""
    literal = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in rules]
    return spark.range(1).select(F.explode(F.array(*literal)).alias("r")).select("r.*")


def labels(host: str) -> Column:
    """How many labels a host has."""
    return F.expr(f"length({host}) - length(replace({host}, '.', '')) + 1")


def expressions(host: str, path: str, shapes: list[tuple[int, int]]) -> Column:
    """The last labels of a host and the first characters of a path, for each (labels, characters) that a rule has and the url offers.

    Each is cut out of the url by itself, so a host of any number of labels costs its length a shape.
    """
    of = ", ".join(f"named_struct('k', {k}, 'n', {n})" for k, n in shapes)
    fits = f"{host} <> '' AND length({host}) - length(replace({host}, '.', '')) + 1 >= s.k AND length({path}) >= s.n"
    cut = f"transform(filter(array({of}), s -> {fits}), s -> concat(substring_index({host}, '.', -s.k), left({path}, s.n)))"
    return F.expr(cut if shapes else "cast(array() AS array<string>)")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Judges every row of pages by the longest rule that fits its url.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's. Urls are
    expanded into host suffixes with path prefixes, of those numbers of labels and characters only that occur together in
    a rule (so the work a url is its length times these shapes), each hashed; rows and rules meet in an equi-join
    on the first SHORT digits of the SHA-256, and full digests are compared before precedence decides: the longest
    rule, then the longer host, then block. Equal urls are expanded and joined once.

    Returns key, host, path, rule (host and path of the winner, else null) and verdict (the rule's, else `default`),
    one row for each row of pages. Null urls and urls without :// have empty host and path and no rule. Repeated rows
    stay repeated, repeated rules count once, rules with a null are ignored, and an empty table gives an empty one.
    """
    clean = rules.filter("host is not null and path is not null and verdict is not null").select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    shapes = sorted(map(tuple, clean.select(labels("rule_host"), F.length("rule_path")).distinct().collect()))
    rows = pages.select(F.col(key).alias("page_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    distinct = rows.select("host", "path").distinct()
    wide = distinct.withColumn("expression", F.explode(expressions("host", "path", shapes)))
    wide = wide.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.left("digest", F.lit(SHORT)))
    hashed = clean.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.left("rule_digest", F.lit(SHORT)))
    # host and path are told apart: the text of an expression alone does not say where its host ends
    few = hashed if hashed.count() > BROADCAST_RULES else F.broadcast(hashed)
    hits = wide.join(few, "short").filter((F.col("digest") == F.col("rule_digest")) & fits())
    order = F.struct(F.length("rule"), F.length("rule_host"), (F.col("rule_verdict") == "block"), F.col("rule"), F.col("rule_verdict"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    found = rows.join(best, ["host", "path"], "left")
    return found.select(F.col("page_key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def fits() -> Column:
    own = (F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host")))
    return own & F.col("path").startswith(F.col("rule_path"))
