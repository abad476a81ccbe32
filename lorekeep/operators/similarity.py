"""Similar vectors at scale: random-projection buckets with exact verification, and upkeep of the pairs for changed vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from .graph import PAIRS, block_count, close_pairs, nearest_of, similar_pairs

#: Vectors that a bucket should hold, so that its scores are one small matrix product.
HELD = 512
#: Vectors of one block of a bucket.
BLOCK = 2048
SEED = 17
PAIR = "source long, target long, score double"


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """bits of a bucket's code and number of tables for n vectors, or (0, 0) where comparing all costs no more.

    Two unit vectors at the threshold fall on one side of a random plane with the chance p = 1 - angle / pi, so they share a
    bucket of some table with the chance 1 - (1 - p ** bits) ** tables. Tables are as many as the recall asks for; unlike
    vectors share a bucket with 2 ** -bits, so the pairs compared grow like n to the power 1 + log p / log 0.5. A recall of 1
    is only had by comparing all.
    """
    if recall >= 1:
        return 0, 0
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = max(0, round(math.log2(max(n, 1) / HELD)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - p**bits)) if bits else 0
    return (bits, tables) if bits and tables < 2**bits else (0, 0)


def coded(batches: Iterator, bits: int, tables: int, seed: int) -> Iterator:
    """id, embedding -> id, embedding, bucket for each table."""
    import numpy as np
    import pyarrow as pa

    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column("embedding").to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        for dims in np.unique(sizes):
            if dims not in planes:
                planes[dims] = np.random.default_rng([seed, int(dims)]).standard_normal((int(dims), bits * tables))
            rows = np.flatnonzero(sizes == dims)
            side = np.nan_to_num(np.stack(vectors[rows]).astype("f8")) @ planes[dims] > 0
            code = (side.reshape(len(rows), tables, bits) << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)
            for t in range(tables):
                bucket = pa.array(code[:, t] * 100_000 + dims)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(rows)) for c in ("id", "embedding")] + [bucket], ["id", "embedding", "bucket"])


def bucketed(vectors: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """id, embedding, bucket: a row for each table; vectors of unlike length never share a bucket."""
    ship(vectors.sparkSession)
    schema = StructType([vectors.schema["id"], vectors.schema["embedding"], *StructType.fromDDL("bucket bigint").fields])

    def work(batches):
        return coded(batches, bits, tables, seed)

    return vectors.filter("embedding is not null").select("id", "embedding").mapInArrow(work, schema)


def products(threshold: float):
    """A function that scores the two sides of a group (part 0 and part 1; only part 2: with itself) exactly and keeps what reaches the threshold."""
    import numpy as np
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list] = {0: [], 1: [], 2: []}
        vectors: dict[int, list] = {0: [], 1: [], 2: []}
        for batch in batches:
            part, some = batch.column("part").to_numpy(), batch.column("id").to_numpy()
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1) if len(some) else None
            for p in np.unique(part).tolist():
                ids[p].append(some[part == p])
                vectors[p].append(values[part == p])
        own = {p: (np.concatenate(ids[p]), np.concatenate(vectors[p])) for p in ids if ids[p]}
        left, right = (own[2], own[2]) if 2 in own else (own.get(0), own.get(1))
        if left is None or right is None:
            return
        for a, b, score in close_pairs(left[1], right[1], threshold):
            one, two = left[0][a], right[0][b]
            keep = one < two if 2 in own else one != two
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.minimum(one, two), np.maximum(one, two), score)], ["source", "target", "score"])

    work.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return work


def near_pairs(vectors: DataFrame, threshold: float, recall: float = 0.97, bits: int | None = None) -> DataFrame:
    """source < target and score of the pairs at or above the threshold, of which about `recall` or more are found; every score is exact.

    For unit vectors (of any length each; unlike lengths have no score). Equal vectors are one while buckets are made; each
    then stands for its class of copies, all of which are linked to the smallest id of the class and carry its pairs (what
    links copies to one another is left to the class: see copies()). A bucket of more than BLOCK vectors is compared in
    pairs of blocks, so no task holds more. Where plan() says that buckets do not pay, all pairs are compared: that is exact.
    """
    single = copies(vectors).groupBy("representative").agg(F.first("embedding").alias("embedding")).withColumnRenamed("representative", "id")
    n = single.count()
    bits, tables = plan(n, threshold, recall) if bits is None else (bits, math.ceil(math.log(1 - recall) / math.log(1 - (1 - math.acos(threshold) / math.pi) ** bits)))
    if not bits:
        return similar_pairs(single, threshold)
    rows = bucketed(single, bits, tables)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("bucket", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j")))
    rows = rows.withColumn("p", F.explode(F.array_distinct(others))).select("bucket", "p.i", "p.j", "id", "embedding", F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("block") == F.col("p.i"), 0).otherwise(1).alias("part"))
    return rows.groupBy("bucket", "i", "j").applyInArrow(products(threshold), PAIR).distinct()


def copies(vectors: DataFrame) -> DataFrame:
    """id, embedding, representative: the smallest id with the same vector."""
    rows = vectors.filter("embedding is not null").select("id", "embedding")
    least = rows.groupBy("embedding").agg(F.min("id").alias("representative"))
    return rows.join(least, "embedding").select("id", "embedding", "representative")


def compared(vectors: DataFrame, bits: int, tables: int) -> int:
    """How many pairs of vectors the buckets bring together."""
    held = bucketed(vectors, bits, tables).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0


def refreshed_pairs(pairs: DataFrame, vectors: DataFrame, changed: DataFrame, threshold: float) -> DataFrame:
    """The pairs of `vectors` as they are now, from the pairs before some ids changed, came or went.

    Only the changed ids are compared, with all vectors: they are dealt into blocks, all vectors into blocks of their own,
    and each pair of blocks is one matrix product. Pairs without a changed end are taken over.
    """
    ids = changed.select("id").distinct()
    kept = pairs.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    rows = vectors.filter("embedding is not null").select("id", "embedding", F.size("embedding").alias("dims"))
    asks = rows.join(ids, "id", "left_semi")
    n_rows, n_asks = block_count(rows), block_count(asks)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select("id", "embedding", "dims", F.lit(0).alias("part"), block(n_asks).alias("i"), spread(n_rows).alias("j"))
    right = rows.select("id", "embedding", "dims", F.lit(1).alias("part"), spread(n_asks).alias("i"), block(n_rows).alias("j"))
    found = left.unionByName(right).groupBy("dims", "i", "j").applyInArrow(products(threshold), PAIR).distinct()
    return kept.select("source", "target", "score").unionByName(found)


def nearest_products(threshold: float, k: int):
    """A function that scores part 0 of a group against part 1 and keeps the k best of each id: of part 0, and of those of part 1 that are not
    marked themselves, the best among the marked ones of part 0."""
    import numpy as np
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, list[list]] = {0: [], 1: []}
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.num_rows
            columns = [batch.column("id").to_numpy(), batch.column("mark").to_numpy(zero_copy_only=False)]
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else None
            for p in np.unique(part).tolist():
                sides[p].append([x[part == p] for x in (*columns, values)])
        if not sides[0] or not sides[1]:
            return
        (one, changed, left), (two, asks, right) = ([np.concatenate(x) for x in zip(*sides[p], strict=True)] for p in (0, 1))
        held, size = [], 0
        for a, b, score in close_pairs(left, right, threshold):
            unlike = one[a] != two[b]
            back = unlike & changed[a] & ~asks[b]
            held += [(one[a][unlike], two[b][unlike], score[unlike]), (two[b][back], one[a][back], score[back])]
            size += int(unlike.sum() + back.sum())
            if size >= 16 * PAIRS + 2 * k * (len(one) + len(two)):
                held = [nearest_of(held, k)]
                size = len(held[0][0])
        if size:
            found = nearest_of(held, k)
            for at in range(0, len(found[0]), PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + PAIRS]) for x in found], ["source", "target", "score"])

    work.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return work


def refreshed_nearest(nearest: DataFrame, vectors: DataFrame, changed: DataFrame, threshold: float, k: int) -> DataFrame:
    """source, target, score: the k nearest of every vector as they are now, from those before some ids changed, came or went.

    Who had fewer than k has them all, and a full list without a changed id stays the best of the unchanged. So only changed
    ids, and those whose full list had one, are compared with all vectors; of the others' pairs those with changed ids are
    new. Pairs that are nobody's nearest are never kept, so nothing grows with the square of the vectors but the products.
    """
    ids = changed.select("id").distinct()
    ended = ids.select(F.col("id").alias("target"), F.lit(1).alias("ended"))
    old = nearest.select("source", "target", "score").join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ended, "target", "left")
    short = old.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("ended").alias("lost")).filter((F.col("n") >= k) & (F.col("lost") > 0)).select(F.col("source").alias("id"))
    asking = ids.withColumn("mark", F.lit(True)).unionByName(short.withColumn("mark", F.lit(False)))
    rows = vectors.filter("embedding is not null").select("id", "embedding", F.size("embedding").alias("dims"))
    rows = rows.join(asking, "id", "left")
    asks = rows.filter("mark is not null")
    n_rows, n_asks = block_count(rows), block_count(asks)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select("id", "embedding", "dims", "mark", F.lit(0).alias("part"), block(n_asks).alias("i"), spread(n_rows).alias("j"))
    right = rows.select("id", "embedding", "dims", F.col("mark").isNotNull().alias("mark"), F.lit(1).alias("part"), spread(n_asks).alias("i"), block(n_rows).alias("j"))
    fresh = left.unionByName(right).groupBy("dims", "i", "j").applyInArrow(nearest_products(threshold, k), PAIR)
    kept = old.filter("ended is null").join(short.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target", "score")
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "target"))
    return kept.unionByName(fresh).withColumn("place", place).filter(F.col("place") <= k).select("source", "target", "score")
