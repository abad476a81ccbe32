"""Token counts by rank-synchronous array merging.

Batched pre-tokens are ragged numpy arrays of symbols. In each round every pre-token finds its lowest-rank adjacent
pair and all of them merge at once; the symbols left when no pair has a rank are the tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_words as W
from .common import widened, without

NEVER = np.int64(1 << 40)
#: Bytes from which on a pre-token is merged along links, so that a round touches only what it changes.
LONG = 256


class MergeTable:
    """The merges of a vocabulary file as sorted arrays: pair key -> rank, merged symbol."""

    def __init__(self, path: str):
        model = W.description(path)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = W.byte_letters()
        self.plain = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = np.int64(len(vocab))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made, self.made_by = keys[order], np.arange(len(pairs), dtype=np.int64)[order], made[order], made

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank NEVER where there is no merge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], NEVER), self.made[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) pre-token."""
        raw = [w.encode() for w in words]
        out = np.ones(len(raw), np.int64)
        long = np.array([len(r) >= LONG for r in raw], bool)
        for own, count in ((long, self.linked), (~long, self.ragged)):
            if own.any():
                out[own] = count([r for r, there in zip(raw, own.tolist(), strict=True) if there])
        return out

    def symbols(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pre-tokens' symbols, the pre-token of each, and where each pre-token ends."""
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        found, ends = self.plain[flat], np.cumsum(sizes) - 1
        found[ends] = self.last[flat[ends]]
        return found, np.repeat(np.arange(len(raw)), sizes), ends

    def linked(self, raw: list[bytes]) -> np.ndarray:
        """Tokens of long pre-tokens: one round a rank, over the places that wait for it.

        A merge makes a symbol that only higher ranks use, so the ranks come in ascending order, and a round looks up
        only the pairs beside the places that it merged.
        """
        symbols, owner, ends = self.symbols(raw)
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends], before[np.r_[0, ends[:-1] + 1]] = n, -1
        alive, rank = np.ones(n, bool), np.full(n, NEVER)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            rank[at] = NEVER
            at = at[after[at] < n]
            rank[at], _ = self.find(symbols[at], symbols[after[at]])
            at = at[rank[at] < NEVER]
            at = at[np.argsort(rank[at], kind="stable")]
            first = np.flatnonzero(np.r_[True, np.diff(rank[at]) > 0]) if len(at) else ()
            for r, part in zip(rank[at[first]].tolist() if len(at) else (), np.split(at, first[1:]) if len(at) else (), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        look(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            at = at[alternate(np.r_[False, after[at[:-1]] == at[1:]])]
            gone = after[at]
            symbols[at], alive[gone], rank[gone] = self.made_by[r], False, NEVER
            after[at] = after[gone]
            inside = at[after[at] < n]
            before[after[inside]] = inside
            left = before[at]
            look(np.unique(np.r_[at, left[left >= 0]]))
        return np.bincount(owner[alive], minlength=len(raw))

    def ragged(self, raw: list[bytes]) -> np.ndarray:
        """Tokens of short pre-tokens: in each round every one of them merges the pair of its lowest rank."""
        out = np.ones(len(raw), np.int64)
        symbols, owner, _ = self.symbols(raw)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[starts, len(symbols)])
            rank, made = self.find(symbols[:-1], symbols[1:])
            rank = np.r_[np.where(owner[:-1] == owner[1:], rank, NEVER), NEVER]
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NEVER
            out[owner[starts[done]]] = length[done]
            at = np.flatnonzero((rank == np.repeat(lowest, length)) & (rank < NEVER))
            if not len(at):
                break
            at = at[alternate(np.r_[False, np.diff(at) == 1])]
            symbols[at] = made[at]
            keep = np.repeat(~done, length)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


def alternate(follows: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (a a a) every second one merges, counted from the left of its run; follows: overlaps the one before."""
    run = np.flatnonzero(~follows)
    nth = np.arange(len(follows)) - np.repeat(run, np.diff(np.r_[run, len(follows)]))
    return nth % 2 == 0


class Counter(dict):
    """Chunk -> its tokens; the pre-tokens of those not seen before are merged together, batch by batch."""

    def __init__(self, path: str):
        super().__init__()
        self.table, self.tokenizer = MergeTable(path), W.load(path)
        specials = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = W.re.compile("|".join(W.re.escape(t.content) for t in specials) or r"(?!)")

    def split(self, text: str) -> tuple[list[str], int]:
        """Parts of any text that are tokenised alone, and the special tokens that stand in it."""
        found = W.chunks(text)
        if found is not None:
            return found, 0
        parts = self.specials.split(text)
        return [
            self.decoded(w)
            for part in parts
            for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))
        ], len(parts) - 1

    def decoded(self, word: str) -> str:
        """The library shows a pre-token as one letter a byte; this is its text again."""
        if not hasattr(self, "back"):
            self.back = {c: b for b, c in W.byte_letters().items()}
        return bytes(self.back[c] for c in word).decode()

    def of(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        new = {w for words, _ in split for w in words if w not in self}
        if len(self) + len(new) > W.REMEMBERED:
            self.clear()
            new = {w for words, _ in split for w in words}
        if new:
            held = {w: [w] if not W.usual(w) else W.PRE_TOKEN.findall(w) for w in new}
            inside = list({p for parts in held.values() for p in parts})
            tokens = dict(zip(inside, self.table.counts(inside).tolist(), strict=True))
            self.update((w, sum(map(tokens.__getitem__, parts))) for w, parts in held.items())
        return [sum(map(self.__getitem__, words)) + extra for words, extra in split]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to every row; no shuffle, one pass.

    The counts equal the tokenizers library's for the vocabulary file (which must be at that path on every
    executor), without special tokens added; special strings inside a text count as one token. A null text is empty:
    0 bytes, 0 tokens. Columns of the input with one of the three names are replaced; other columns pass through.
    Repeated rows stay repeated; an empty table gives an empty one. Texts of any length are counted whole.
    """
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in others), pa.array(counter.of(texts), pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())],
                schema=pa.schema([*(batch.schema.field(i) for i in others), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]),
            )

    at, others = docs.columns.index(text), range(len(docs.columns))
    schema = widened(docs.schema, "n_tokens long, n_bytes long")
    counted = docs.mapInArrow(work, schema)
    return counted.select(*docs.columns, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
