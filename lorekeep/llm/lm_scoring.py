"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import Hashes, mix, pairs

#: What stands after the last word and before the first; no word holds a space.
END, START = " ", "  "
#: A bigram seen c times is held at the levels 1 .. 1 + floor(log(c) / log(GROWTH)).
GROWTH = 1.5
LEVELS = 64
BITS_A_KEY = 12
#: Tokens that are counted or looked up together, and training tokens meant for one shard of the model.
FLUSH, SHARD_TOKENS = 1_000_000, 1_000_000
#: Shards that a task builds, on average.
SHARDS_PER_TASK = 2
#: A model of up to so many bytes is broadcast; the n-grams of the documents are dealt to the shards of a larger one.
BROADCAST_BYTES = 256 << 20
#: Rows scored together.
SLICE = 250


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard number from the top bits; shards is a power of two."""
    bits = np.uint64(shards.bit_length() - 1)
    return (hashes >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(GROWTH) + 1e-9).astype(np.int64)


def level_counts() -> np.ndarray:
    """The count that stands for each level: the middle of its range; nothing for level 0."""
    low = np.ceil(GROWTH ** np.arange(LEVELS))
    return np.r_[0.0, (low + np.maximum(low, np.ceil(GROWTH ** np.arange(1, LEVELS + 1)) - 1)) / 2]


def probes(hashes: np.ndarray, at: int | np.ndarray, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bit mask of (bigram, level) in a filter of `sizes` 64-bit words; five bits of one word."""
    y = mix(hashes + np.asarray(at).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    mask = np.zeros(len(y), np.uint64)
    for i in range(5):
        mask |= np.uint64(1) << ((y >> np.uint64(6 * i)) & np.uint64(63))
    return ((y >> np.uint64(32)) % np.asarray(sizes).astype(np.uint64)).astype(np.int64), mask


class Flat:
    """The word hashes of some texts, one after the other, each text between START and END."""

    def __init__(self, hashes: Hashes, texts: list[str | None]):
        start, end = (np.array([hashes[x]], np.uint64) for x in (START, END))
        self.fill([np.concatenate([start, hashes.of(t), end]) for t in texts])

    def fill(self, docs: list[np.ndarray]) -> None:
        self.lengths = np.array([len(d) for d in docs], np.int64)
        self.words = np.concatenate(docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.begins = np.zeros(len(self.words), bool)
        self.begins[self.starts] = True

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Flat:
        found = cls.__new__(cls)
        found.fill(docs)
        return found

    def bigrams(self) -> np.ndarray:
        """Of each word with the one before it; those of a START mean nothing."""
        return np.r_[np.uint64(0), pairs(self.words[:-1], self.words[1:])]

    def keys(self) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Distinct words and distinct bigrams of the tokens, each with how often it occurs."""
        return tuple(np.unique(x[~self.begins], return_counts=True) for x in (self.words, self.bigrams()))


def batched(texts: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    """Consecutive rows (text last) of so many characters in all, or one row."""
    held, size = [], 0
    for row in texts:
        held.append(row)
        size += len(row[-1] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as the lowest byte of each, then the next one of each, as many as the largest needs."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def whole(raw: bytes, n: int) -> np.ndarray:
    """The n numbers that planes() was given."""
    found = np.zeros((n, 8), np.uint8)
    if n:
        found[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return found.view("<u8").ravel()


def packed(hashes: np.ndarray, counts: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending hashes as the first one and steps of as few bytes as the largest needs, and counts likewise."""
    return int(hashes[:1].view(np.int64)[0]), planes(np.diff(hashes)), planes(counts)


def unpacked(first: int, steps: bytes, counts: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and counts that packed() was given."""
    return np.cumsum(np.concatenate([np.array([first], np.int64).view(np.uint64), whole(steps, size - 1)])), whole(counts, size).astype(np.int64)


def cut(found: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """Shard, from and to of the stretches of ascending hashes."""
    shard = shard_of(found, shards)
    at = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
    return [(int(shard[a]), a, b) for a, b in zip(at, at[1:], strict=False)]


PACKED = {"shard": pa.int32(), "bigram": pa.bool_(), "size": pa.int32(), "first": pa.int64(), "steps": pa.binary(), "counts": pa.binary()}


def counted(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The words and bigrams of training rows, counted over some millions of characters at a time: a packed row for each shard."""
    hashes = Hashes()
    for rows in batched(((t,) for b in batches for t in b.column(0).to_pylist()), 6 * FLUSH):
        for bigram, (found, n) in enumerate(Flat(hashes, [t for (t,) in rows]).keys()):
            out = [(shard, bool(bigram), b - a, *packed(found[a:b], n[a:b])) for shard, a, b in cut(found, shards)]
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 256], strict=True), PACKED.values(), strict=True)], names=list(PACKED))


def built(shard: int, rows: pa.Table) -> pa.RecordBatch:
    """One shard of the model: exact word counts and the Bloom filter of its bigrams."""
    parts: dict[bool, list] = {False: [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], True: [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]}
    for r in rows.to_pylist():
        parts[r["bigram"]].append(unpacked(r["first"], r["steps"], r["counts"], r["size"]))

    def summed(bigram: bool) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = (np.concatenate(x) for x in zip(*parts.pop(bigram), strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]]))
        return hashes[new], np.add.reduceat(n[order], new) if len(new) else n

    (words, counts), (grams, seen) = summed(False), summed(True)
    levels = level(np.maximum(seen, 1))
    size = max(1, -(-int(levels.sum()) * BITS_A_KEY // 64))
    bloom = np.zeros(size, np.uint64)
    for j in range(1, int(levels.max(initial=0)) + 1):
        at, mask = probes(grams[levels >= j], j, size)
        np.bitwise_or.at(bloom, at, mask)
    values = (np.int32(shard), int(counts.sum()), len(words), 16 * len(words) + 8 * len(bloom), words.tobytes(), counts.tobytes(), bloom.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["shard", "tokens", "distinct", "size", "words", "counts", "bloom"])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the shards of a partition, whose packed n-grams are held together: about SHARD_TOKENS a shard at most."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        shard = batch["shard"].to_numpy()
        order = np.argsort(shard, kind="stable")
        batch, shard = batch.take(pa.array(order)), shard[order]
        for a, b in zip(at := [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)], at[1:], strict=False):
            if a < b:
                held.setdefault(int(shard[a]), []).append(batch.slice(a, b - a))
    for shard in sorted(held):
        yield built(shard, pa.Table.from_batches(held.pop(shard)))


class Model:
    """Some shards of the model, as flat arrays."""

    def __init__(self, rows: Iterator, sizes: list, shards: int):
        self.shards = shards
        self.words = np.zeros(sum(r["distinct"] for r in sizes), np.uint64)
        self.counts = np.zeros(len(self.words), np.int64)
        self.bloom = np.zeros(sum(r["size"] - 16 * r["distinct"] for r in sizes) // 8, np.uint64)
        self.sizes, self.starts = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        first, at, word = {}, 0, 0
        for r in sizes:  # ascending shards, so the words ascend too
            first[r["shard"]] = word
            self.sizes[r["shard"]], self.starts[r["shard"]] = (r["size"] - 16 * r["distinct"]) // 8, at
            at, word = at + self.sizes[r["shard"]], word + r["distinct"]
        for r in rows:
            words, bloom = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["bloom"], "<u8")
            at, word = self.starts[r["shard"]], first[r["shard"]]
            self.words[word : word + len(words)] = words
            self.counts[word : word + len(words)] = np.frombuffer(r["counts"], "<i8")
            self.bloom[at : at + len(bloom)] = bloom

    def word_counts(self, hashes: np.ndarray) -> np.ndarray:
        found, back = np.unique(hashes, return_inverse=True)
        return looked_up(self.words, self.counts, found)[back]

    def levels(self, bigrams: np.ndarray) -> np.ndarray:
        shard = shard_of(bigrams, self.shards)
        return probed(self.bloom, self.starts[shard], self.sizes[shard], bigrams)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, the keys ascending; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


def probed(bloom: np.ndarray, start: np.ndarray, size: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Repeated membership probes: the highest level below which none is missing."""
    out = np.zeros(len(bigrams), np.int8)
    todo = np.flatnonzero(size)
    size, start = size[todo], start[todo]
    for j in range(1, LEVELS):
        at, mask = probes(bigrams[todo], j, size)
        there = (bloom[start + at] & mask) == mask
        todo, size, start = todo[there], size[there], start[there]
        if not len(todo):
            break
        out[todo] = j
    return out


def log_probabilities(counts: np.ndarray, before: np.ndarray, pair: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the smoothed unigram, and of the bigram interpolated with it.

    A context seen c times gives the mass m / (c + m) to the unigrams, m = c ** 0.75 + 1.
    """
    unigram = (counts + 0.5) / (total + 0.5 * (distinct + 1))
    mass = before**0.75 + 1
    pair = np.minimum(pair, np.minimum(counts, before))  # a filter errs upwards only; no pair is more frequent than its words
    return np.log10(unigram), np.log10((pair + mass * unigram) / (before + mass))


def sums(flat: Flat, counts: np.ndarray, levels: np.ndarray, total: int, distinct: int) -> list[pa.Array]:
    """n_tokens, n_known, train_tokens, base_score, score of each text, from the counts and levels of its tokens."""
    # a start is as frequent as an end; it is a context, not a token
    documents = counts[flat.starts[0] + flat.lengths[0] - 1]
    before = np.where(flat.begins, documents, counts)[:-1]
    unigram, bigram = log_probabilities(counts[1:], before, level_counts()[levels[1:]], total, distinct)
    token, n = ~flat.begins[1:], len(flat.lengths)
    owner = np.repeat(np.arange(n), flat.lengths)[1:][token]
    known = np.bincount(owner, counts[1:][token] > 0, minlength=n).astype(np.int64)
    return [pa.array(flat.lengths - 1), pa.array(known), pa.array(np.full(n, total, np.int64)), *(pa.array(np.bincount(owner, x[token], minlength=n)) for x in (unigram, bigram))]


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def with_broadcast(rows: DataFrame, model: DataFrame, sizes: list, shards: int, total: int, distinct: int, schema: str) -> DataFrame:
    """Scores rows (doc_id, held_out, text) in one pass, every worker holding the model."""
    shared = rows.sparkSession.sparkContext.broadcast(Model(model.select("shard", "words", "counts", "bloom").toLocalIterator(), sizes, shards))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(), shared.value
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                flat = Flat(hashes, batch.column(2).to_pylist())
                found = sums(flat, held.word_counts(flat.words), held.levels(flat.bigrams()), total, distinct)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], names=RESULT)

    return rows.mapInArrow(work, schema)


def with_shards(rows: DataFrame, model: DataFrame, shards: int, total: int, distinct: int, schema: str) -> DataFrame:
    """Scores rows (doc_id, held_out, text) by dealing their n-grams to the shards of the model; one pass, whatever its size.

    Texts are read once, in batches that are stored as numbers of their distinct words. A batch asks each shard for its
    distinct n-grams of that hash range, packed into one row; the shard answers from its word counts and its filter with a
    byte or two for each, and the answers, shard by shard, are in the order of the batch's n-grams.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each batch of documents; the words are numbered by how often they occur, so the numbers are small."""
        hashes, at = Hashes(), TaskContext.get().partitionId() << 32
        for part in batched(((b.column(0).slice(i, 1), b.column(1).slice(i, 1), t) for b in batches for i, t in enumerate(b.column(2).to_pylist())), 6 * FLUSH):
            flat = Flat(hashes, [t for *_, t in part])
            found, back, n = np.unique(flat.words, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            ids, held = (pa.concat_arrays([x[i] for x in part]) for i in (0, 1))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), x) for x in (ids, held, pa.array(flat.lengths))]
            yield pa.RecordBatch.from_arrays([pa.array([at]), *lists, pa.array([found[order].tobytes()]), pa.array([planes(np.argsort(order)[back])])], names=names)
            at += 1

    def read(lengths: pa.ListScalar, known: bytes, words: bytes) -> Flat:
        sizes = lengths.values.to_numpy()
        return Flat.of(np.split(np.frombuffer(known, "<u8")[whole(words, int(sizes.sum())).view(np.int64)], np.cumsum(sizes)[:-1]))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, lengths, known, words in zip(*batch.columns, strict=True):
                for bigram, (found, _) in enumerate(read(lengths, known.as_py(), words.as_py()).keys()):
                    out = [(shard, of.as_py(), bool(bigram), b - a, *packed(found[a:b], found[:0])[:2]) for shard, a, b in cut(found, shards)]
                    for at in range(0, len(out), 256):
                        yield pa.RecordBatch.from_pylist([dict(zip(asked.names, x, strict=True)) for x in out[at : at + 256]], asked)

    def answered(key: tuple, questions: pa.Table, shard: pa.Table) -> pa.Table:
        out = []
        if len(shard):
            words, counts, bloom = (np.frombuffer(shard[c][0].as_py(), t) for c, t in (("words", "<u8"), ("counts", "<i8"), ("bloom", "<u8")))
        for r in questions.to_pylist():
            wanted = unpacked(r["first"], r["steps"], b"", r["size"])[0]
            value = np.zeros(len(wanted), np.int64)
            if len(shard):
                value = probed(bloom, np.zeros(len(wanted), np.int64), np.full(len(wanted), len(bloom)), wanted) if r["bigram"] else looked_up(words, counts, wanted)
            out.append({"of": r["of"], "bigram": r["bigram"], "shard": r["shard"], "size": r["size"], "answers": planes(value)})
        return pa.Table.from_pylist(out, pa.schema({"of": pa.int64(), "bigram": pa.bool_(), "shard": pa.int32(), "size": pa.int32(), "answers": pa.binary()}))

    def scored(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        flat = read(docs["lengths"][0], docs["distinct"][0].as_py(), docs["words"][0].as_py())
        parts = sorted(answers.to_pylist(), key=lambda r: (r["bigram"], r["shard"]))

        def of(bigram: bool, found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            value = np.concatenate([np.zeros(0, np.int64), *(whole(r["answers"], r["size"]).view(np.int64) for r in parts if r["bigram"] == bigram)])
            if len(value) != len(found):
                raise ValueError(f"batch {key[0]}: {len(value)} answers to {len(found)} n-grams")
            return looked_up(found, value, wanted)

        (own, _), (grams, _) = flat.keys()
        found = sums(flat, of(False, own, flat.words), of(True, grams, flat.bigrams()), total, distinct)
        return pa.Table.from_arrays([docs["ids"].combine_chunks().flatten(), docs["held"].combine_chunks().flatten(), *found], names=RESULT)

    names = ["batch", "ids", "held", "lengths", "distinct", "words"]
    asked = pa.schema({"shard": pa.int32(), "of": pa.int64(), "bigram": pa.bool_(), "size": pa.int32(), "first": pa.int64(), "steps": pa.binary()})
    parts = stored(rows.mapInArrow(split, f"batch long, ids array<{kind}>, held array<boolean>, lengths array<long>, distinct binary, words binary"), "lm-batches")
    questions = parts.select("batch", "lengths", "distinct", "words").mapInArrow(asks, "shard int, of long, bigram boolean, size int, first long, steps binary")
    answers = questions.groupBy("shard").cogroup(model.select("shard", "words", "counts", "bloom").groupBy("shard")).applyInArrow(answered, "of long, bigram boolean, shard int, size int, answers binary")
    return parts.groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(scored, schema)


def score(docs: DataFrame, fold: int = 5, held_out: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Scores every row of docs (doc_id, text) with a bigram model learnt from all rows that are not held out.

    Held out are rows whose crc32(doc_id as text; empty for null) modulo `fold` is `held_out`. The model is built shard
    by shard from all training tokens: exact counts of words (by their 64-bit hash; two of V words share one with a
    chance of about V**2 / 2**65) and a blocked Bloom filter of (bigram, log-count level). It grows with the corpus. Up
    to broadcast_bytes of it are broadcast; of a larger one every shard answers the probes of its hash range (see
    with_shards), which gives the same scores in one pass over the texts. A filter errs upwards: at 12 bits a key about
    one probe in a hundred of an absent level succeeds.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (seen in training), train_tokens, base_score (add
    0.5 unigrams) and score (the model's log10 probability). A null text is empty: just the end. Without training rows
    every count is 0. Repeated rows stay repeated, other columns are not read, an empty table gives an empty one.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold
    rows = docs.select("doc_id", (rest == held_out).alias("held_out"), "text")
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(1, size // 6 // SHARD_TOKENS).bit_length() - 1
    # a shard's n-grams travel packed, a row for each batch of texts: some seven bytes an n-gram
    kinds = "shard int, bigram boolean, size int, first long, steps binary, counts binary"
    counts = rows.filter(~F.col("held_out")).select("text").mapInArrow(partial(counted, shards=shards), kinds).repartition(-(-shards // SHARDS_PER_TASK), "shard")
    model = stored(counts.mapInArrow(by_shard, "shard int, tokens long, distinct long, size long, words binary, counts binary, bloom binary"), "lm-model")
    total, distinct, held = model.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "size")]).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if held > broadcast_bytes:
        return with_shards(rows, model, shards, total, distinct, schema)
    sizes = model.select("shard", "tokens", "distinct", "size").orderBy("shard").collect()  # of a model of that size
    return with_broadcast(rows, model, sizes, shards, total, distinct, schema)
