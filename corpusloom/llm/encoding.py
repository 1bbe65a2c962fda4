"""Byte-level BPE ids from a tokenizer file, and their places in the text.

The file is the JSON of the ``tokenizers`` library. Its vocabulary is run by ``tiktoken``, which gives the same
ids several times faster; ``load`` compares the two on probes and falls back to ``tokenizers`` where they differ.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The split pattern of the byte-level pre-tokenizer. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = ("", "Plain words, 12 of them.", "  two  blanks\n\n and\ttabs \r\n", "é ß 日本語 🙂 ña", "it's we'll 3.14 x==y <|endoftext|>", "a" * 300, "THE!! THE*** $$$ | | Ö̈")
#: A single blank between two others: every pre-token ends before it.
SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as the library gives them: a special token's string in a text is that token, unless
    ``special_as_text`` asks for ordinary text there."""

    def __init__(self, path: str, special_as_text: bool = False):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        table = byte_of()
        added = [t for t in model.get("added_tokens", []) if t["special"]]
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(table[c] for c in token): number for token, number in model["model"]["vocab"].items() if token not in special}
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = special_as_text
        self.special = set() if special_as_text else set(special)
        self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        #: A text in pieces: only where no special token can lie across a cut.
        self.divisible = not any(SAFE.search(f"x{t}x") for t in special)
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, number in ranks.items():
            self.sizes[number] = len(token)
        for token, number in special.items():
            self.sizes[number] = len(token.encode())
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        if not plain or any(self._quick(p) != self.exact.encode(p, add_special_tokens=False).ids for p in (*PROBES, *(f"a {t} {t}{t}b" for t in special))):
            self.quick = None

    def ids(self, text: str, piece: int = 1 << 20) -> np.ndarray:
        """The ids of the whole text (uint32); long texts are encoded in pieces that end where pre-tokens do."""
        if len(text) <= piece or not self.divisible:
            return self._ids(text)
        found, start = [], 0
        while start < len(text):
            safe = SAFE.search(text, start + piece - 1)
            end = safe.start() if safe else len(text)
            found.append(self._ids(text[start:end]))
            start = end
        return np.concatenate(found)

    def _quick(self, text: str) -> list[int]:
        return self.quick.encode(text, allowed_special=self.special, disallowed_special=()) if self.special else self.quick.encode_ordinary(text)

    def _ids(self, text: str) -> np.ndarray:
        if self.quick is None:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self._quick(text), dtype=np.uint32)

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 byte at which each id's token ends; the tokens of a text cover it without gaps."""
        return np.cumsum(self.sizes[ids])
