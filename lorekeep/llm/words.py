"""Words of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
REMEMBERED = 300_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of x over all bits."""
    x = (x ^ (x >> np.uint64(32))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of word pairs."""
    return mix(left * A + right)


class Hashes(dict):
    """Word -> XXH64 of its UTF-8 bytes, remembered."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased."""
        words = WORD.findall(text.encode().lower().decode()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
