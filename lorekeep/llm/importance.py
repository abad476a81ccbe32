"""Quality selection by importance resampling over hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, without
from .words import Hashes, pairs

#: Hash buckets of each model; what the driver holds and broadcasts is this many numbers.
BUCKETS = 1 << 16
#: Labelled target documents that the target model is fitted on, at most.
TARGET_ROWS = 50_000
#: Added to every bucket of the target and of the raw model.
SMOOTHING = 0.5


def grams(hashes: Hashes, text: str | None, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    words = hashes.of(text)
    return (np.concatenate([words, pairs(words[:-1], words[1:])]) % np.uint64(buckets)).astype(np.int64)


def model_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw, target: n-grams of all rows, and of those with is_target."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            found = [grams(hashes, t, buckets) for t in batch.column(0).to_pylist()]
            for row, some in enumerate((found, [g for g, target in zip(found, batch.column(1).to_pylist(), strict=True) if target])):
                if some:
                    counts[row] += np.bincount(np.concatenate(some), minlength=buckets)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    rows = docs.select("text", "is_target").mapInArrow(work, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, buckets: int) -> np.ndarray:
    """log of target over raw probability, bucket by bucket (at most `buckets` rows reach the driver)."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    smooth = [np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * buckets)) for x in (target, raw)]
    return smooth[0] - smooth[1]


def weighted(docs: DataFrame, ratio: np.ndarray, length: int | None) -> DataFrame:
    """doc_id, n_grams, log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = Hashes(), shared.value
        for batch in batches:
            found = [grams(hashes, t, len(ratio)) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(g) for g in found], np.int64)
            sums = np.array([ratio[g].sum() for g in found])
            if length:
                sums *= length / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes), pa.array(sums)], names=["doc_id", "row_key", "n_grams", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(work, f"doc_id {kind}, row_key long, n_grams long, log_weight double")


def threshold(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of column `key_rank`, found 16 bits at a time: each step brings at most 65,536 counts to the driver."""
    if k <= 0:
        return None
    rest, prefix = keys, None
    for shift in (32, 16, 0):
        counts = sorted(((r["part"], r["count"]) for r in rest.groupBy(F.shiftright("key_rank", shift).alias("part")).count().collect()), reverse=True)
        for part, count in counts:
            if k <= count:
                break
            k -= count
        else:
            return None if prefix is None and not counts else counts[-1][0] << shift
        prefix = part
        rest = rest.filter(F.shiftright("key_rank", shift) == prefix)
    return prefix


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, buckets: int = BUCKETS, length: int | None = None, target_rows: int = TARGET_ROWS, seed: int = 42) -> DataFrame:
    """Importance resampling of docs (doc_id, text) towards the documents labelled good.

    Two bag models over hashed words and word pairs are counted: the raw one over all rows, the target one over the rows
    labelled quality 1 and not toxic (a bounded sample of at most target_rows of them, by hash of doc_id). A row's
    log weight is the log of the ratio of its probabilities under the two; `length`, an option that departs from plain
    importance weights, scales it to a text of so many n-grams. Adding Gumbel noise and taking the k largest draws k rows without replacement; k is `fraction` of the rows, by default
    the share of quality 1 among the labels.

    Returns doc_id, n_grams, log_weight, gumbel_key and kept for every row. Keys are compared to six decimals; rows
    tied with the k-th all stay, so repeated rows share one fate. Null and empty texts weigh 0. Without labels all rows
    stay. Labels with nulls count as not good; repeated labels count once.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    good = good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("is_target", F.lit(True))
    if fraction is None:
        fraction = labels.agg(F.avg((F.coalesce("quality", F.lit(0)) == 1).cast("double"))).first()[0]
        fraction = 1.0 if fraction is None else fraction
    rows = docs.select("doc_id", "text")
    marked = rows.join(F.broadcast(good), "doc_id", "left")  # at most target_rows ids
    ratio = log_ratio(model_counts(marked, buckets), buckets)
    uniform = (F.shiftrightunsigned(F.xxhash64("row_key", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    found = weighted(rows, ratio, length).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    rank = F.least(F.greatest(F.round(F.col("gumbel_key") * 1e6), F.lit(-(2.0**46))), F.lit(2.0**46)).cast("long")
    found = stored(found.withColumn("key_rank", rank), "importance")
    least = threshold(found, round(fraction * found.count()))
    kept = F.lit(False) if least is None else F.col("key_rank") >= least
    return found.select("doc_id", "n_grams", "log_weight", "gumbel_key", kept.alias("kept"))
