"""Fuzzy line deduplication: MinHash candidates, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import ship
from . import line_signatures
from .common import SPACES, free, release, stored, without
from .line_signatures import MINIMA, SEED

#: A band is BAND_ROWS of the minima of a signature; two bands share one at most. Two lines of a kind that agree in all
#: minima of a band are candidates.
BANDS, BAND_ROWS = 16, 3
#: The similarity (4 / 5) that links two lines.
SIMILAR = (4, 5)
#: Equal minima, of 32, that two lines of a bucket need to be compared further: similar lines have 21 or more in the mean,
#: and fewer than these in one of 10^7 pairs.
ALIKE = 8
#: Where a bucket is still apart, its lines are first compared with so many that look most like them.
BEST = 4
#: Lines of a bucket that one task compares with others at a time.
BLOCK = 2048
#: Rows of 8 to 24 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Texts that travel to a Python worker at a time.
TEXTS = 1000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored frame, broadcast where its counted rows are so many at most."""
    return F.broadcast(df) if df.count() <= most else df


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Arrow batches have so many rows at most; what is used there must be run there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lines_of(docs: DataFrame, *more: Column) -> DataFrame:
    """place, line, lh (hash of the line) of every non-blank line, and more columns."""
    split = docs.select(*more, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return split.filter(F.btrim("line", F.lit(SPACES)) != "").withColumn("lh", F.xxhash64("line"))


def choices() -> list[tuple[int, ...]]:
    """The minima of each band: drawn so that two bands never share more than one."""
    drawn, together, found = list(combinations(range(MINIMA), BAND_ROWS)), set(), []
    random.Random(SEED).shuffle(drawn)
    for choice in drawn:
        pairs = set(combinations(choice, 2))
        if len(found) < BANDS and not pairs & together:
            found.append(choice)
            together |= pairs
    return found


def signed(docs: DataFrame) -> DataFrame:
    """lh, n, kind, minima of the lines of docs; a line appears once a batch of its documents, n being its copies there.

    Signatures are made where the documents are read, so no text is shuffled.
    """
    return docs.select("text").mapInArrow(line_signatures.signed, "lh bigint, n bigint, kind int, minima array<int>")


def bands() -> Column:
    """The number and the key of each band of a signature."""
    keys = [F.struct(F.lit(b).alias("number"), F.xxhash64("kind", F.lit(b), *[F.col("minima")[i] for i in choice]).alias("band")) for b, choice in enumerate(choices())]
    return F.explode(F.array(*keys)).alias("b")


def verified(texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those pairs (a, b) of line hashes whose lines (lh, line, n: shingles) have similar shingle sets, as a stored table.

    Sets of too unlike sizes cannot be similar; such pairs go before any text is fetched.
    """
    over, under = SIMILAR
    sizes, sides = few(texts.select("lh", "n")), pairs
    for side in "ab":
        sides = sides.join(sizes.select(F.col("lh").alias(side), F.col("n").alias(f"n_{side}")), side)
    sides = sides.filter(under * F.least("n_a", "n_b") >= over * F.greatest("n_a", "n_b")).select("a", "b")
    for side in "ab":
        sides = sides.join(texts.select(F.col("lh").alias(side), F.col("line").alias(f"line_{side}")), side)
    judged = sides.mapInArrow(partial(line_signatures.similar, over=over, under=under), "a bigint, b bigint")
    return stored(judged, name)


def apart(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows of the buckets whose lines are not all in one component yet, with their label, as a stored table."""
    labelled = rows.drop("label").join(joined.withColumnRenamed("node", "lh"), "lh", "left").withColumn("label", F.coalesce("root", "lh")).drop("root")
    spread = labelled.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("band")
    return stored(labelled.join(spread, "band", "left_semi"), "line-apart")


def lookalikes(left: DataFrame, signs: DataFrame, best: int | None) -> DataFrame:
    """a, b: lines of different labels of one bucket whose signatures look alike; for each line the best few of each block, or all
    that can be similar (signs then have n and sketch).

    A bucket of many lines is cut into blocks of about BLOCK lines. The lines outside of its largest component ask, in each
    block; those of the largest one only answer, so a large group of copies that is joined already costs little. Signatures
    take part, no texts, and what comes out is a few rows for each that asks and block, or those of all that the sizes and
    sketches do not rule out: lines that only resemble each other are compared, but make no rows.
    """
    signed = ["minima"] if best is not None else ["minima", "n", "sketch"]
    sizes = left.groupBy("band", "label").agg(F.count(F.lit(1)).alias("held"))
    most = sizes.groupBy("band").agg(F.max_by("label", F.struct("held", "label")).alias("main"), F.ceil(F.sum("held") / BLOCK).cast("int").alias("blocks"))
    rows = left.join(most, "band").join(signs, ["lh", "kind"]).select("band", "lh", "label", *signed, "blocks", (F.col("label") != F.col("main")).alias("outside"))
    answers = rows.select("band", F.pmod("lh", "blocks").cast("int").alias("block"), F.lit(0).alias("asks"), "lh", "label", *signed)
    asks = rows.filter("outside").select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "lh", "label", *signed)
    dealt = answers.union(asks).repartition("band", "block").sortWithinPartitions("band", "block", "asks")
    return dealt.mapInArrow(partial(line_signatures.partners, least=ALIKE, best=best, over=SIMILAR[0], under=SIMILAR[1]), "a bigint, b bigint").distinct()


def sketches(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """lh, n, sketch of the lines of rows, from their texts."""
    own = texts.join(rows.select("lh").distinct(), "lh", "left_semi")
    return own.mapInArrow(line_signatures.sketched, "lh bigint, n bigint, sketch array<bigint>")


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) with further links (a, b): what is linked are whole components, by their roots."""
    ends = links
    for side in "ab":
        ends = ends.join(joined.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    ends = stored(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct(), "line-merges")
    over = components(ends, "line-roots").withColumnRenamed("node", "old").withColumnRenamed("root", "new")
    moved = joined.join(over, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    lone = over.join(joined.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return stored(moved.union(lone), "line-joined")


def similar_lines(docs: DataFrame, distinct: DataFrame, exact: bool = True) -> DataFrame:
    """node, root: the components of similar distinct lines (lh, kind, minima), each of two lines or more.

    Lines that share a band are candidates, and only what connects is of interest. First every line is compared with
    the smallest of each of its buckets. Where a bucket still holds several components, the lines outside of the largest
    are compared with the four that look most like them by their signatures, and where it then still does, with all that
    look alike at all (8 of 32 minima), so that no link between candidates is left out. In that last round a sketch of each
    line's shingles rules out most pairs, without error, where signatures are compared. Its time can grow with the square of a
    group of lines that resemble each other without being similar, its pairs do not; without exact it is left out.
    """
    keyed = distinct.select("lh", "kind", bands()).select("lh", "kind", "b.number", "b.band")
    shared = stored(keyed.groupBy("band").agg(F.min("lh").alias("first"), F.max("lh").alias("last")).filter("first <> last"), "line-buckets")
    rows = stored(keyed.join(few(shared), "band").select("lh", "kind", "band", "first").distinct(), "line-candidates")
    involved = stored(rows.select("lh").distinct(), "line-involved")
    texts = lines_of(docs).select("lh", "line").join(few(involved), "lh", "left_semi").groupBy("lh").agg(F.first("line").alias("line"))
    texts = stored(texts.mapInArrow(line_signatures.sized, "lh bigint, line string, n bigint"), "line-texts")

    def joined_with(before: DataFrame | None, pairs: DataFrame) -> DataFrame:
        links = verified(texts, pairs, "line-links")
        return components(links, "line-components") if before is None else merged(before, links)

    signs = distinct.select("lh", "kind", "minima").join(few(involved), "lh", "left_semi").groupBy("lh", "kind").agg(F.first("minima").alias("minima"))
    signs = stored(signs, "line-signs")
    stars = rows.filter("lh <> first").select(F.col("first").alias("a"), F.col("lh").alias("b"), "kind").distinct()
    for side in "ab":
        stars = stars.join(signs.select(F.col("lh").alias(side), "kind", F.col("minima").alias(f"signs_{side}")), [side, "kind"])
    equal = F.expr("aggregate(zip_with(signs_a, signs_b, (x, y) -> CASE WHEN x = y THEN 1 ELSE 0 END), 0, (n, e) -> n + e)")
    tried = stored(stars.filter(equal >= ALIKE).select("a", "b").distinct(), "line-pairs")
    joined = joined_with(None, tried)
    # the two lines of a bucket of two have been compared
    larger = rows.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter("held > 2").select("band")
    left = apart(rows.drop("first").join(larger, "band", "left_semi"), joined)
    for best in (BEST, *[None] * exact):
        told = signs if best is not None else stored(signs.join(sketches(texts, left), "lh"), "line-sketches")
        pairs = stored(lookalikes(left, told, best).join(tried, ["a", "b"], "left_anti"), "line-pairs")
        if best is None:
            release(told)
        joined, last, tried = joined_with(joined, pairs), left, tried.union(pairs)
        left = apart(last, joined)
        release(last)
    release(shared, rows, involved, texts, signs, left)
    return joined


def removals(docs: DataFrame, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The lines to drop, as row_key and places, and the lines that stay in their stead, likewise; both stored."""
    with arrow_batches(docs.sparkSession, TEXTS):
        distinct = stored(signed(docs), "line-signatures")
    joined = similar_lines(docs, distinct, exact)
    alone = distinct.groupBy("lh").agg(F.sum("n").alias("n")).filter("n > 1").select("lh").join(joined.select(F.col("node").alias("lh")), "lh", "left_anti")
    affected = stored(joined.select(F.col("node").alias("lh"), "root").union(alone.select("lh", F.col("lh").alias("root"))), "line-affected")
    found = lines_of(docs, F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row_key")).drop("line").join(few(affected), "lh")
    found = stored(found.select("root", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "place").alias("where")), "line-places")
    keep = stored(found.groupBy("root").agg(F.min("where").alias("keep")), "line-keepers")
    gone = found.join(few(keep), "root").filter("where <> keep").select("where.row_key", "where.place")
    places = F.collect_set("place").alias("places")
    out = stored(gone.groupBy("row_key").agg(places), "line-removals"), stored(keep.select("keep.row_key", "keep.place").groupBy("row_key").agg(places), "line-kept")
    release(distinct, affected, found, keep)
    return out


def dedup_lines(docs: DataFrame, exact: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) with one line left of each group of similar lines, and n_lines and n_removed_lines.

    Two lines are linked if the Jaccard similarity of their sets of 5-character shingles, one at every position (a
    shorter line, filled up with zero characters, is one), is 0.8 or more (exactly verified). Of each connected component one occurrence of one line
    stays, that of the smallest doc_id (null comes last; ties: the smaller row hash, then the first place), and all
    others go. Candidates are lines that share a band of a MinHash signature; all of them are compared, but
    for those that are known to be connected (see similar_lines; without exact: with few of a bucket). Lines and shingles are told apart by 64-bit hash.

    Blank lines are never removed. Null and empty texts have no lines and stay as they are; a text that loses every
    line becomes empty. Of repeated rows (equal doc_id and text) one, whichever, keeps the lines that stay. doc_id may
    be of any type that has an order. A column n_chars is brought up to date, columns named as the two counts are
    replaced, all others pass through whatever their names, and an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    docs = without(docs, "n_lines", "n_removed_lines")
    key, gone, own, lines, left, number = free(docs, "row_key", "gone", "own", "lines", "left_text", "number")
    lost, kept = removals(docs.select("doc_id", "text"), exact)
    lost, kept = lost.toDF(key, gone), kept.toDF(key, own)
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    twins = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias(own)).filter(F.col(own) > 1).select(key).join(kept, key, "left_semi"), "line-twins")
    places = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    if twins.isEmpty():
        marked = rows.join(small(lost, gone), key, "left")
    else:
        # all but one of the rows that are alike lose what one of them keeps
        alike = stored(rows.join(few(twins), key, "left_semi").withColumn(number, F.monotonically_increasing_id()), "line-alike")
        first = alike.groupBy(key).agg(F.min(number).alias(lines))
        alike = alike.join(first, key).join(lost, key, "left").join(kept, key)
        alike = alike.withColumn(gone, F.when(F.col(number) == F.col(lines), places).otherwise(F.array_union(places, F.col(own)))).drop(number, lines, own)
        marked = rows.join(few(twins), key, "left_anti").join(small(lost, gone), key, "left").unionByName(alike)
    marked = marked.withColumn(lines, F.split("text", "\n"))
    stays = F.expr(f"array_join(transform(array_sort(array_except(sequence(0, size(`{lines}`) - 1), `{gone}`)), i -> `{lines}`[i]), '\\n')")
    marked = marked.withColumn(left, F.when(F.size(places) == 0, F.col("text")).otherwise(stays))
    filled = F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")), F.lit(0))
    columns = [F.col(left).alias(c) if c == "text" else F.length(left).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(filled).cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_removed_lines"))


def small(lost: DataFrame, gone: str) -> DataFrame:
    """The removals, broadcast where the places that they count allow that."""
    places = lost.agg(F.sum(F.size(gone))).first()[0] or 0
    return F.broadcast(lost) if places <= BROADCAST_ROWS else lost
