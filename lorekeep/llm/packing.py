"""Packing token sequences into fixed windows with Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_words as W
from .common import stored, widened

#: Pieces that one task packs together; a group of this size leaves well under one window in a hundred empty.
GROUP_PIECES = 4096
#: Groups that a task packs, one after the other.
GROUPS_PER_TASK = 4
#: Window numbers that each group has for itself.
GROUP_WINDOWS = 1 << 20


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """Splits sizes into `ways` near-equal parts; the part number of each.

    Every item starts as a partial partition with one filled part. The two partitions with the widest spread merge
    again and again, the fullest part of one with the emptiest part of the other, until one partition is left.
    """
    n = len(sizes)
    if ways <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # parts hold numbers of tree nodes: 0 is empty, 1..n the items, above that the unions
    left, right, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], n + 1
    heap = []
    for i, s in enumerate(sizes):
        parts, held = np.zeros(ways, np.int64), np.zeros(ways, np.int64)
        parts[0], held[0] = s, i + 1
        heap.append((-int(s), i, parts, held))
    heapq.heapify(heap)
    for turn in range(n, 2 * n - 1):
        _, _, a, ha = heapq.heappop(heap)
        _, _, b, hb = heapq.heappop(heap)
        total, hb = a + b[::-1], hb[::-1]
        both = np.flatnonzero((ha > 0) & (hb > 0))
        held = np.maximum(ha, hb)
        held[both] = np.arange(nodes, nodes + len(both))
        left.append(ha[both])
        right.append(hb[both])
        nodes += len(both)
        order = np.argsort(-total, kind="stable")
        total = total[order]
        heapq.heappush(heap, (int(total[-1] - total[0]), turn, total - total[-1], held[order]))
    held = heap[0][3]
    part = np.zeros(nodes, np.int64)
    part[held] = np.arange(ways)
    left, right = np.concatenate(left), np.concatenate(right)
    for node in range(nodes - 1, n, -1):  # from the last union down to the items
        part[left[node - n - 1]] = part[right[node - n - 1]] = part[node]
    return part[1 : n + 1]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each piece; no window holds more than capacity. Full pieces have one for themselves."""
    out = np.empty(len(sizes), np.int64)
    full = sizes >= capacity
    out[full] = np.arange(full.sum())
    rest = sizes[~full]
    ways = max(1, -(-int(rest.sum()) // capacity))
    while True:
        part = difference(rest, ways)
        over = np.bincount(part, rest, minlength=ways).max(initial=0) - capacity
        if over <= 0:
            break
        ways += 1  # the count rises whenever capacity is exceeded
    out[~full] = part + full.sum()
    return out


def cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Lengths of a document's pieces: whole windows first, then the rest in equal pieces of at most `piece`."""
    full, rest = divmod(n, capacity)
    parts = -(-rest // piece)
    return [capacity] * full + [rest // parts + (i < rest % parts) for i in range(parts)]


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, piece: int, end: int, with_ids: bool) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece; tokenising and cutting need no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = W.IdBytes(W.load(vocabulary)).of, np.uint32(end).tobytes()
        for batch in batches:
            owner, start, length, crc, total, held = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = of(text or "") + last
                n, at = len(ids) // 4, 0
                for size in cuts(n, capacity, piece):
                    part = ids[4 * at : 4 * (at + size)]
                    owner.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        held.append(np.frombuffer(part, "<u4"))
                    at += size
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int64()))] if with_ids else []), names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, piece: int = 512, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; one row for each piece.

    Each document is its ids and then `end`; it is cut into whole windows and pieces of at most `piece` tokens. Groups
    of about GROUP_PIECES pieces, whatever document they come from, are packed by Karmarkar-Karp differencing, each
    by itself: a hot source or a huge document is spread over all groups, and only piece lengths are shuffled. With
    pieces this small the windows come out within a few tokens of each other.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for). A null text is
    empty, so its document is the one token `end`. Repeated rows are packed as often as they occur, a null doc_id stays
    null, other columns are not read, and an empty table packs into an empty one.
    """
    pieces = stored(cut_documents(docs, vocabulary, capacity, piece, end, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    keyed = pieces.withColumn("piece_row", F.monotonically_increasing_id())
    keyed = keyed.withColumn("piece_group", F.pmod(F.xxhash64("doc_id", "start", "piece_row"), F.lit(groups)))

    def work(part: pa.Table) -> pa.Table:
        part = part.sort_by("piece_row")
        window = windows(part["length"].to_numpy(), capacity)
        order = np.argsort(window, kind="stable")
        part, window = part.take(order), window[order]
        length = part["length"].to_numpy()
        before = np.cumsum(length) - length
        first = np.r_[True, window[1:] != window[:-1]]
        offset = before - before[np.flatnonzero(first)][np.cumsum(first) - 1]
        sequence = part["piece_group"].to_numpy() * GROUP_WINDOWS + window
        return part.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = pieces.columns
    schema = widened(pieces.schema, "sequence_id long, offset long")
    return keyed.repartition(-(-groups // GROUPS_PER_TASK), "piece_group").groupBy("piece_group").applyInArrow(work, schema)
