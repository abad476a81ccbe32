"""SimHash near-duplicates, compared bit-sliced."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import free, stored, without

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BITS = 64
#: Shingles hashed at once, so that a text of any length needs bounded memory.
CHUNK = 1 << 18
#: A block of fingerprints whose bit planes are one machine word each.
LANES = 64
#: (query, block) comparisons under way at once.
TASKS = 1 << 16
#: Buckets with more fingerprints are divided by further bits.
BUCKET = 2048
#: Bit planes added between two looks for blocks to abandon.
STRIDE = 8


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """SimHash over the XXH64 of all shingles of `width` words, repeats included, as a signed long."""
    from xxhash import xxh64_intdigest

    words = WORD.findall(text.encode().lower().decode()) if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + width - 1]
        shingles = map(" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.uint32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), fp of every row. A null or wordless text has fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width, seed) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], names=["doc_id", "row_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(work, f"doc_id {kind}, row_key long, fp long")


def planes(members: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of LANES fingerprints: [blocks, 64] words, word b holding bit b of every member."""
    bits = np.unpackbits(members.reshape(-1, LANES, 1).view(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def near(queries: np.ndarray, block: np.ndarray, sliced: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each task (a query, the number of a block) the lanes within the radius, as a word.

    The planes of a block, flipped where the query has a one, are added into bitwise counters by carry-save steps; the
    top counter saturates. Tasks whose lanes all exceed the radius are abandoned between strides.
    """
    levels = max(1, radius.bit_length())
    todo = np.arange(len(queries))
    counters = np.zeros((levels, len(queries)), np.uint64)
    over = ~valid[block]
    for bit in range(BITS):
        carry = sliced[block[todo], bit] ^ (np.uint64(0) - ((queries[todo] >> np.uint64(bit)) & np.uint64(1)))
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if bit % STRIDE == STRIDE - 1 or bit == BITS - 1:
            over |= exceeding(counters, radius)
            alive = over != ~np.uint64(0)
            if not alive.all():
                todo, over, counters = todo[alive], over[alive], counters[:, alive]
    out = np.zeros(len(queries), np.uint64)
    out[todo] = ~over
    return out


def exceeding(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            above |= equal & counters[level]
            equal &= ~counters[level]
    return above


def lowest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: every member gets the lowest label it reaches."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def linked(values: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, bucket by bucket, all fingerprints within the radius: a spanning set, never all pairs.

    bucket holds ascending bucket numbers. Each bucket is cut into blocks of LANES lanes, and each of its fingerprints
    is compared with its own block and those after it.
    """
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    own = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(bucket)) - starts[own]
    per = -(-sizes // LANES)
    first = np.cumsum(per) - per
    block, lane = first[own] + within // LANES, within % LANES
    members = np.zeros((int(per.sum()), LANES), np.uint64)
    members[block, lane] = values
    valid = np.zeros(len(members), np.uint64)
    np.bitwise_or.at(valid, block, np.uint64(1) << lane.astype(np.uint64))
    index = np.zeros(members.shape, np.int64)
    index[block, lane] = np.arange(len(values))
    sliced = planes(members)
    label = np.arange(len(values))
    left = (first + per)[own] - block  # blocks that each fingerprint has to meet
    ends = np.cumsum(left)
    for at in range(0, int(ends[-1]), TASKS):
        task = np.arange(at, min(at + TASKS, int(ends[-1])))
        query = np.searchsorted(ends, task, "right")
        target = block[query] + task - (ends[query] - left[query])
        mask = near(values[query], target, sliced, valid, radius)
        hit = np.flatnonzero(mask)
        bits = np.unpackbits(mask[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, col = np.nonzero(bits)
        label = lowest(query[hit[row]], index[target[hit[row]], col], label)
    apart = np.flatnonzero(label != np.arange(len(values)))
    return values[apart], values[label[apart]]


def keys(radius: int, parts: int) -> list[tuple[int, ...]]:
    """The choices of parts that stay untouched when at most `radius` of them differ."""
    return list(combinations(range(parts), parts - radius))


def candidates(distinct: DataFrame, radius: int) -> DataFrame:
    """fp, bucket: two fingerprints within the radius share at least one bucket (pigeonhole over radius + 2 parts).

    A bucket above BUCKET fingerprints is divided by the same rule applied to the bits that it leaves open, so even
    then no pair is lost, and what two levels leave open bounds a bucket whatever the data.
    """
    parts = radius + 2
    width = BITS // parts
    spans = [(i * width, BITS if i == parts - 1 else (i + 1) * width) for i in range(parts)]

    def mask(bits: list[int]) -> int:
        value = sum(1 << b for b in bits)
        return value - (1 << BITS) if value >> (BITS - 1) else value

    first = [mask([b for i in kept for b in range(*spans[i])]) for kept in keys(radius, parts)]

    def inner(kept: tuple[int, ...]) -> list[int]:
        """Masks of the second level, in the same order for every choice."""
        free = [b for i in range(parts) if i not in kept for b in range(*spans[i])]
        step = -(-len(free) // parts)
        return [mask([b for i in sub for b in free[i * step : (i + 1) * step]]) for sub in keys(radius, parts)]

    def table(masks: list[int], base) -> F.Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), (F.col("fp").bitwiseAND(F.lit(m).cast("long"))).alias("k")) for i, m in enumerate(masks)])).alias("b")

    coarse = distinct.select("fp", table(first, None)).select("fp", "b.t", "b.k")
    big = coarse.groupBy("t", "k").count().filter(F.col("count") > BUCKET).select("t", "k")
    small = coarse.join(big, ["t", "k"], "left_anti").select("fp", "t", F.lit(-1).alias("s"), "k")
    choices = [inner(kept) for kept in keys(radius, parts)]
    held = coarse.join(big, ["t", "k"], "left_semi")
    sub = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for masks in choices])
    fine = held.select("fp", "t", "k", F.posexplode(F.get(sub, F.col("t"))).alias("s", "m"))
    return small.union(fine.select("fp", "t", "s", F.col("k").bitwiseOR(F.col("fp").bitwiseAND(F.col("m"))).alias("k")))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """a, b: fingerprints whose links join everything within the radius."""
    rows = candidates(distinct, radius)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            fp = whole["fp"].to_numpy()
            change = np.r_[True, np.any([np.diff(whole[c].to_numpy()) != 0 for c in "tsk"], axis=0)]
            bucket = np.cumsum(change)
            many = np.bincount(bucket)[bucket] > 1
            a, b = linked(fp[many].view(np.uint64), bucket[many], radius) if many.any() else (fp[:0], fp[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # everything before the last bucket that this batch begins is complete
            change = np.flatnonzero(np.any([np.diff(batch[c].to_numpy()) != 0 for c in "tsk"], axis=0))
            if not len(change):
                if held and any(held[-1][c][-1] != batch[c][0] for c in "tsk"):
                    yield ready(held)
                    held = []
                held.append(batch)
                continue
            cut = int(change[-1]) + 1
            yield ready([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        if held:
            yield ready(held)

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "t", "s", "k").sortWithinPartitions("t", "s", "k").mapInArrow(work, "a long, b long")


def judged(docs: DataFrame, radius: int, width: int, seed: int) -> DataFrame:
    """doc_id, row_key, fp, root (of the component), component_id of every row."""
    found = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = components(links(distinct.select("fp"), radius), "simhash-links")
    groups = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(groups.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id of every row; needs doc_id and text, reads no other column.

    Rows with equal fingerprints are one node; nodes link at `radius` or fewer differing bits, and component_id is the
    smallest doc_id reachable (null only where all of a component are null). Every link is found: candidates come
    from the pigeonhole principle and no bucket is capped. Equal fingerprints never meet pair by pair, so any number
    of copies costs one row each. Null, empty and wordless texts have fingerprint zero and link like any other.
    Repeated rows stay repeated; an empty table gives an empty one; texts are read whole.
    """
    fingerprint_text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return judged(docs, radius, width, seed).select("doc_id", fingerprint_text, "component_id")


def keep_one(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """One row of each near-duplicate group of docs, that with the smallest doc_id; columns as they came.

    Of several rows with that doc_id (or where no row has one) the smallest row hash decides, and of equal rows any.
    """
    found = judged(docs, radius, width, seed).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # a doc_id may be the smallest of several groups, or none have one: the root tells groups apart
    stay = found.groupBy("root").agg(F.min("row_key").alias("row_key"))
    (key,) = free(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    kept = keyed.join(stay.select(F.col("row_key").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(*docs.columns)
