"""Signatures and exact similarity of lines on numpy arrays: shingles at every position, a batch of lines at a time."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .common import SPACES
from .words import mix

#: The seed of Spark's xxhash64.
HASH_SEED = 42

#: Characters of the shingles whose sets are compared, one at every position of a line.
SHINGLE_CHARS = 5
#: Characters of the shingles that are signed; longer ones tell unlike lines of one language apart far better.
SIGNED_CHARS = 9
#: Lines of at most FEW distinct compared shingles are signed by these (kind 0), lines of at least MANY by the longer ones
#: (kind 1); between, by both. Similar sets differ by a fifth at most, so two similar lines always have a kind in common,
#: however long they are.
FEW, MANY = 12, 10
MINIMA = 32
SEED = 11
#: Characters of a batch that are hashed at once, so that what is made of them stays small; longer lines are hashed in
#: pieces.
PIECE = 1 << 18
#: Bytes of texts that are split into lines at a time.
SPLIT = 1 << 21
#: Bits of the sketch of a set of shingles (a power of two).
BITS = 1024
BASE = 0x9E3779B97F4A7C15
ODD, CUBE = np.uint64(BASE), np.uint64(BASE**3 % (1 << 64))


def orders() -> np.ndarray:
    """Each stands for the order of hashes after an exclusive or with it: the smallest hash then is a MinHash."""
    rng = random.Random(SEED)
    return np.array([rng.getrandbits(32) for _ in range(MINIMA)], np.uint32)


def joined(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of lines one after the other, and where each begins; a line shorter than width is filled up with zeros."""
    lines = [x if len(x) >= width else x.ljust(width, "\0") for x in lines]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def shingles(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each position: the shingle that begins there, or the line's first one where none does."""
    c = np.concatenate([codes, np.zeros(width - 1, np.uint32)]).astype(np.uint64)
    if width == 9:  # of three threes
        c = (c[:-2] * ODD + c[1:-1]) * ODD + c[2:]
        h = (c[:-6] * CUBE + c[3:-3]) * CUBE + c[6:]
    else:
        h = c[: len(codes)]
        for i in range(1, width):
            h = h * ODD + c[i : i + len(codes)]
    ends = np.repeat(starts[1:], width - 1) - np.tile(np.arange(width - 1, 0, -1), len(starts) - 1)
    h[ends] = h[np.repeat(starts[:-1], width - 1)]
    return mix(h)


def minima(lines: list[str], width: int) -> np.ndarray:
    """lines x MINIMA: the signatures of lines."""
    codes, starts = joined(lines, width)
    h = (shingles(codes, starts, width) >> np.uint64(32)).astype(np.uint32)
    found, turned = np.empty((len(lines), MINIMA), np.uint32), np.empty_like(h)
    for i, p in enumerate(orders()):
        found[:, i] = np.minimum.reduceat(np.bitwise_xor(h, p, out=turned), starts[:-1])
    return found.view(np.int32)


def pieces(line: str, width: int) -> list[str]:
    """Parts of a line that have all of its shingles between them."""
    return [line[i : i + PIECE + width - 1] for i in range(0, max(1, len(line) - width + 1), PIECE)]


def signatures(lines: list[str], width: int) -> np.ndarray:
    """As minima(), in bounded memory for lines of any length."""
    found = np.empty((len(lines), MINIMA), np.int32)
    size, waiting = 0, []
    for i, line in enumerate(lines):
        if len(line) > PIECE:
            found[i] = np.min([minima([x], width).view(np.uint32)[0] for x in pieces(line, width)], axis=0).view(np.int32)
            continue
        waiting.append(i)
        size += len(line)
        if size >= PIECE:
            found[waiting] = minima([lines[j] for j in waiting], width)
            size, waiting = 0, []
    if waiting:
        found[waiting] = minima([lines[j] for j in waiting], width)
    return found


def distinct_upto(line: str, most: int) -> int:
    """How many distinct compared shingles a line has, or more than most."""
    ends = most + SHINGLE_CHARS
    if len(line) >= ends and len({line[i : i + SHINGLE_CHARS] for i in range(most + 1)}) > most:
        return most + 1
    found: set[str] = set()
    for i in range(max(1, len(line) - SHINGLE_CHARS + 1)):
        found.add(line[i : i + SHINGLE_CHARS])
        if len(found) > most:
            break
    return len(found)


def lines_in(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(SPACES)]


def signed(batches: Iterator) -> Iterator:
    """text -> lh, n (copies in a part of the batch), kind, minima of its distinct lines; n is 0 beside a line's second kind.

    A batch is read in parts of some SPLIT bytes, so that no more than these are held as lines at a time.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    def parts() -> Iterator:
        for batch in batches:
            texts = batch.column("text")
            for i, j in runs(pc.binary_length(texts).fill_null(0).to_pylist(), SPLIT):
                yield texts.slice(i, j - i)

    for part in parts():
        copies = Counter(chain.from_iterable(lines_in(t) for t in part.to_pylist() if t))
        if not copies:
            continue
        lines, counts = list(copies), list(copies.values())
        hashes = np.fromiter((xxh64_intdigest(x.encode("utf-8", "surrogatepass"), HASH_SEED) for x in lines), np.uint64, len(lines)).view(np.int64)
        sizes = [distinct_upto(x, FEW) for x in lines]
        for kind, width, chosen in (
            (1, SIGNED_CHARS, [i for i, n in enumerate(sizes) if n >= MANY]),
            (0, SHINGLE_CHARS, [i for i, n in enumerate(sizes) if n <= FEW]),
        ):
            if chosen:
                found = signatures([lines[i] for i in chosen], width)
                n = [0 if kind == 0 and sizes[i] >= MANY else counts[i] for i in chosen]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, MINIMA, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[chosen]), pa.array(n, pa.int64()), pa.array(np.full(len(chosen), kind, np.int32)), lists], ["lh", "n", "kind", "minima"])


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.uint64]:
    """The distinct compared shingles of lines as sorted numbers, the line in the upper bits, and how far these are shifted."""
    codes, starts = joined(lines, SHINGLE_CHARS)
    shift = np.uint64(64 - max(1, len(lines).bit_length()))
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(starts))
    keys = np.sort((owner << shift) | (shingles(codes, starts, SHINGLE_CHARS) >> (np.uint64(64) - shift)))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])], shift


def runs(lines: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about most."""
    at, size = 0, 0
    for i, n in enumerate(lines):
        size += n
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(lines):
        yield at, len(lines)


def sized(batches: Iterator) -> Iterator:
    """lh, line -> lh, line, n: the number of distinct compared shingles."""
    import pyarrow as pa

    for batch in batches:
        lines = batch.column("line").to_pylist()
        n = np.zeros(len(lines), np.int64)
        for i, j in runs([len(x) for x in lines], PIECE):
            keys, shift = shingle_sets(lines[i:j])
            n[i:j] = np.bincount((keys >> shift).astype(np.int64), minlength=j - i)
        yield pa.RecordBatch.from_arrays([batch.column("lh"), batch.column("line"), pa.array(n)], ["lh", "line", "n"])


def odd_bits(keys: np.ndarray, shift: np.uint64, lines: int) -> np.ndarray:
    """lines x (BITS / 64): for each line the parities of how many of its shingles fall on each bit."""
    owner, bit = keys >> shift, (keys >> (shift - np.uint64(BITS.bit_length() - 1))) & np.uint64(BITS - 1)
    counts = np.bincount((owner * np.uint64(BITS) + bit).astype(np.int64), minlength=lines * BITS)
    return np.packbits((counts & 1).astype(np.uint8).reshape(lines, BITS), axis=1).view(np.int64)


def sketched(batches: Iterator) -> Iterator:
    """lh, line, n -> lh, n, sketch: see odd_bits."""
    import pyarrow as pa

    words = BITS // 64
    for batch in batches:
        lines = batch.column("line").to_pylist()
        found = np.zeros((len(lines), words), np.int64)
        for i, j in runs([len(x) + BITS for x in lines], PIECE):
            found[i:j] = odd_bits(*shingle_sets(lines[i:j]), j - i)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, words, dtype=np.int32)), pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("lh"), batch.column("n"), lists], ["lh", "n", "sketch"])


def may_be_similar(n_a: np.ndarray, n_b: np.ndarray, odd_a: np.ndarray, odd_b: np.ndarray, over: int, under: int) -> np.ndarray:
    """Whether sets of these sizes and sketches, pair by pair, can have a Jaccard similarity of over / under; never false where they have.

    A shingle that only one of two sets has turns one bit, so the sets differ in as many shingles as the sketches in bits, or more.
    """
    can = under * np.minimum(n_a, n_b) >= over * np.maximum(n_a, n_b)
    apart = np.bitwise_count((odd_a[can] ^ odd_b[can]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    can[can] = (under + over) * apart <= (under - over) * (n_a[can] + n_b[can])
    return can


def similar(batches: Iterator, over: int, under: int) -> Iterator:
    """a, b, line_a, line_b -> those a, b whose shingle sets have a Jaccard similarity of over / under or more."""
    import pyarrow as pa

    for batch in batches:
        left, right = batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()
        kept = np.zeros(len(left), bool)
        for i, j in runs([len(x) + len(y) for x, y in zip(left, right, strict=True)], PIECE):
            (keys, shift), (others, _) = shingle_sets(left[i:j]), shingle_sets(right[i:j])
            all_keys = np.sort(np.concatenate([keys, others]))
            of = lambda k: np.bincount((k >> shift).astype(np.int64), minlength=j - i)  # noqa: B023, E731
            kept[i:j] = (over + under) * of(all_keys[1:][all_keys[1:] == all_keys[:-1]]) >= over * of(all_keys)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(kept)), batch.column("b").filter(pa.array(kept))], ["a", "b"])


def few_best(equal: np.ndarray, least: int, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the largest entries of each row, `best` at most and none under least."""
    if best >= equal.shape[1]:
        return np.nonzero(equal >= least)
    columns = np.argpartition(equal, -best, axis=1)[:, -best:]
    rows, places = np.nonzero(np.take_along_axis(equal, columns, 1) >= least)
    return rows, columns[rows, places]


def partners(batches: Iterator, least: int, best: int | None, over: int, under: int) -> Iterator:
    """Rows of buckets sorted by (band, block, asks) -> a, b: for each asking row those of its block that look most alike.

    A row that does not ask (asks = 0) stands for itself; the askers come after them and are compared with all of the block,
    minimum by minimum, in slices of bounded size. Only rows with another label and at least `least` equal minima count.
    Every asker gets the best few of them, or (None; rows then have n and sketch) all whose sizes and sketches allow the
    similarity over / under. What is kept of a block is bounded by how blocks are made.
    """
    import pyarrow as pa

    names = ("lh", "label", "minima") if best is not None else ("lh", "label", "minima", "n", "sketch")
    held: dict = {"key": None}

    def asked(own: dict) -> Iterator:
        for i in range(0, len(own["lh"]), 256):
            some = {name: part[i : i + 256] for name, part in own.items()}
            equal = np.zeros((len(some["lh"]), len(held["lh"])), np.int16)
            for k in range(MINIMA):
                equal += some["minima"][:, k, None] == held["minima"][None, :, k]
            equal[some["label"][:, None] == held["label"][None, :]] = 0
            row, column = np.nonzero(equal >= least) if best is None else few_best(equal, least, best)
            for at in range(0, len(row), PIECE) if best is None else ():
                r, c = row[at : at + PIECE], column[at : at + PIECE]
                can = may_be_similar(some["n"][r], held["n"][c], some["sketch"][r], held["sketch"][c], over, under)
                yield some["lh"][r[can]], held["lh"][c[can]]
            if best is not None:
                yield some["lh"][row], held["lh"][column]

    for batch in batches:
        band, block, asks = (batch.column(c).to_numpy() for c in ("band", "block", "asks"))
        if not len(band):
            continue
        rows = {c: batch.column(c).to_numpy() for c in names if c not in ("minima", "sketch")}
        rows |= {c: batch.column(c).flatten().to_numpy().reshape(len(band), -1) for c in names if c in ("minima", "sketch")}
        cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
        out = []
        for i, j in zip([0, *cuts], [*cuts, len(band)], strict=True):
            key = band[i], block[i]
            part = {c: x[i:j] for c, x in rows.items()}
            if asks[i] == 0:
                held = {c: np.concatenate([held[c], x]) for c, x in part.items()} if held["key"] == key else part
                held["key"] = key
            elif held["key"] == key:
                out += [x for x in asked(part) if len(x[0])]
        if out:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
