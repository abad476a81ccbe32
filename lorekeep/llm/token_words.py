"""Pre-tokens and ids of the word-level BPE vocabulary, the way the tokenizers library yields them.

Most texts hold only plain Latin-1 letters, digits and punctuation. For them the library's normaliser is a
lower-casing and its splitter one regular expression, so the pre-tokens come from `re`. Any other text (combining
marks, unusual white space, control characters, special-token strings) goes through the library itself. Either way
a white-space run is looked up once and remembered.
"""

from __future__ import annotations

import json
import re
from array import array

LETTER = "a-zªµºß-öø-ÿ"
NUMBER = "0-9²³¹¼-¾"
#: Contractions, letter runs, single numbers, runs of the rest: the vocabulary file's own pattern, lower case.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
#: Entries a worker remembers before it starts again.
REMEMBERED = 700_000


# What the vocabulary file states about its texts and this module relies on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def description(path: str) -> dict:
    """The vocabulary file's own description; a ValueError if its texts are not split the way this module does it."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model = found["model"]
    same = found.get("normalizer") == NORMALIZER and found.get("pre_tokenizer") == SPLITTER and model.get("type") == "BPE"
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    special = all(t["content"].startswith("<|") for t in found.get("added_tokens", ()))
    if not (same and plain and special):
        raise ValueError(f"{path} is no byte-level BPE vocabulary of lower-cased words, so its tokens would be counted wrongly")
    return found


def load(path: str):
    from tokenizers import Tokenizer

    description(path)
    return Tokenizer.from_file(path)


def usual(text: str) -> bool:
    """Printable Latin-1 with tabs and line ends, and no string of a special token."""
    if "<|" in text or not text.replace("\n", " ").replace("\t", " ").replace("\r", " ").isprintable():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def chunks(text: str) -> list[str] | None:
    """The lower-cased white-space runs of a usual text, which no pre-token crosses; None for other texts."""
    return text.lower().split() if usual(text) else None


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: visible Latin-1 stands for itself, the rest follow at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class IdBytes(dict):
    """Chunk -> its ids as little-endian uint32 bytes, found by the library once."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = [
            token.id
            for word in PRE_TOKEN.findall(chunk)
            for token in self.model.tokenize(word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode())))
        ]
        self[chunk] = found = array("I", ids).tobytes()
        return found

    def of(self, text: str) -> bytes:
        found = chunks(text)
        if found is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, found))
