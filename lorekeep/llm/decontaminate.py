"""Benchmark decontamination with a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, release, stored, widened, without

#: Runs of ASCII letters and digits and of everything beyond ASCII; texts are lower-cased (A-Z) first.
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
#: Words of benchmark text in one broadcast set: some 16 bytes a word and its distinct words, under 50 MB in a worker. A
#: larger benchmark is scanned in blocks of it.
BLOCK_WORDS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: No benchmark word: such a position cannot lie in a window.
OTHER = 0


def fold(text: str) -> str:
    return text.encode().lower().decode()  # of bytes, only A-Z have a lower case


def words_of(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


class Windows:
    """The distinct windows of a block of items: `size` consecutive words, or all words of a shorter item.

    Words are numbered. For each window length, `held` has the windows' hashes (ascending), where in `flat` each window
    stands for verification, and the items of each as slices of one array.
    """

    def __init__(self, items: list[tuple[str | None, list[str]]], size: int):
        self.number: dict[str, int] = {}
        self.names = [item for item, _ in items]
        lengths = np.array([len(words) for _, words in items], np.int64)
        self.flat = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for _, words in items for w in words), np.uint32, lengths.sum())
        starts = np.cumsum(lengths) - lengths
        self.held = {}
        for n in sorted(set(np.minimum(lengths, size).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(lengths, size) == n)
            per = lengths[own] - n + 1
            at = np.repeat(starts[own] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            owner = np.repeat(own, per)
            _, first, group = np.unique(np.lib.stride_tricks.sliding_window_view(self.flat, n)[at], axis=0, return_index=True, return_inverse=True)
            hashes = roll(self.flat, n)[at[first]]
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs = np.unique(np.stack([place[group.reshape(-1)], owner]), axis=1)
            self.held[n] = hashes[order], at[first][order], np.searchsorted(pairs[0], np.arange(len(order) + 1)), pairs[1].astype(np.int32)

    def scan(self, words: list[str]) -> tuple[np.ndarray, set]:
        """Which words lie inside an occurrence of a window, and the items that have one."""
        edge, items = np.zeros(len(words) + 1, np.int64), set()
        ids = np.fromiter((self.number.get(w, OTHER) for w in words), np.uint32, len(words))
        known = np.r_[0, np.cumsum(ids != OTHER)]
        for n, (hashes, at, cut, owners) in self.held.items():
            starts = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else ()
            if not len(starts):
                continue
            hashed = roll(ids, n)[starts]
            low, high = np.searchsorted(hashes, hashed), np.searchsorted(hashes, hashed, "right")
            while (met := low < high).any():  # one turn, but for windows that share a hash
                starts, low, high = starts[met], low[met], high[met]
                same = (ids[starts[:, None] + np.arange(n)] == self.flat[at[low][:, None] + np.arange(n)]).all(1)  # verifies the hit
                np.add.at(edge, starts[same], 1)
                np.add.at(edge, starts[same] + n, -1)
                for window in np.unique(low[same]).tolist():
                    items.update(owners[cut[window] : cut[window + 1]].tolist())
                low = low + 1
        return np.cumsum(edge[:-1]) > 0, {self.names[i] for i in items}


def roll(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n ids from each position on."""
    total = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        total = total * BASE + ids[j : len(total) + j]
    return total ^ (total >> np.uint64(29))


def blocks(benchmark: DataFrame, limit: int, size: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """The items, in blocks of at most `limit` words; only one block is held by the driver at a time.

    A longer item goes on in the next blocks, with the size - 1 words before each cut, so that no window is lost.
    """
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        words = words_of(row["text"])
        last = max(1, len(words) - size + 1)  # windows that the item has
        step = max(1, limit - size + 1)
        for at in range(0, last, step):
            part = words[at : at + step + size - 1] if len(words) > size else words
            if block and held + len(part) > limit:
                yield block
                block, held = [], 0
            block.append((row["item"], part))
            held += len(part)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, least: int = 20, remove: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Judges every row of docs (doc_id, text, ...) by the benchmark windows that occur in its whole text.

    Adds n_words, n_hit (words inside any occurrence of a window), n_items (items with an occurring window),
    items_sha256 and contaminated (n_hit > 0 and least * n_hit >= n_words); input columns of these names are replaced,
    others pass through. The windows are broadcast in blocks of a fixed size, and the documents are scanned once for
    each block, the hits of all blocks gathering in the row; there is no shuffle. Between two blocks the rows are stored,
    so a task holds one block only.

    remove="documents" drops contaminated rows; remove="spans" cuts the hit words out of `text` instead. Null and
    empty texts have no words and are never contaminated; items without words match nothing; a repeated item id counts
    once, and one that is null marks words but is not counted. Repeated rows are judged alike.
    """
    if remove not in (None, "documents", "spans"):
        raise ValueError(f"remove must be documents, spans or None, not {remove!r}")
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = without(docs, *added)
    names, at = docs.columns, docs.columns.index("text")
    hit_words, hit_items, words_before, items_before = free(docs, "hit_words", "hit_items", "words_before", "items_before")
    spark = docs.sparkSession

    def scanned(rows: DataFrame, block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Windows(block, size))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                total, hits, items = [], [], []
                for text in batch.column(at).to_pylist():
                    words = words_of(text)
                    hit, found = windows.scan(words)
                    total.append(len(words))
                    hits.append(np.flatnonzero(hit))
                    items.append(sorted(x for x in found if x is not None))
                extra = [pa.array(total, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "n_words", hit_words, hit_items])

        return rows.mapInArrow(work, widened(rows.schema, f"n_words long, {hit_words} array<long>, {hit_items} array<string>"))

    found = last = None
    for block in blocks(benchmark, block_words, size):
        if found is None:
            found = scanned(docs, block)
            continue
        now = stored(found, "contamination")
        if last is not None:
            release(last)
        last = now
        again = scanned(now.drop("n_words").withColumnsRenamed({hit_words: words_before, hit_items: items_before}), block)
        both = {hit_words: F.array_union(words_before, hit_words), hit_items: F.array_union(items_before, hit_items)}
        found = again.withColumns(both).drop(words_before, items_before)
    found = found.withColumns({"n_hit": F.size(hit_words).cast("long"), "n_items": F.size(hit_items).cast("long")})
    found = found.withColumns({
        "items_sha256": F.sha2(F.array_join(F.array_sort(hit_items), ",").cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * least >= F.col("n_words")),
    })
    if remove == "documents":
        found = found.filter(~F.col("contaminated"))
    if remove == "spans":
        found = cut_spans(found, at, hit_words)
    return found.select(*names, *added)


def cut_spans(found: DataFrame, at: int, hit_words: str) -> DataFrame:
    """text without its hit words (the characters between two hit words of a run go too)."""
    column = found.columns.index(hit_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column(at).to_pylist(), batch.column(column).to_pylist(), strict=True):
                if hits:
                    spans = [m.span() for m in WORD.finditer(fold(text))]
                    hits, kept, last = sorted(hits), [], 0
                    for i, h in enumerate(hits):
                        if i == 0 or h != hits[i - 1] + 1:
                            kept.append(text[last : spans[h][0]])
                        last = spans[h][1]
                    text = "".join([*kept, text[last:]])
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return found.mapInArrow(work, found.schema)

