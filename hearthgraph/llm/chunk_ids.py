"""Ids of a byte-level tokenizers file for whole texts, in the library's own ids.

The file's vocabulary is read into a rank table for the faster of the two installed byte pair
libraries. Both give the same ids when the id order is the merge order and every token encodes
to itself (the tests check both for the file, and the ids on texts). In a text without two white
spaces in a row the pattern's look-ahead never matters, so a pattern without it is used there;
any other text takes the full pattern."""

from __future__ import annotations

import json
import re
from array import array

from .token_counts import PATTERN, byte_letters

PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
_RUN = re.compile(r"\s\s")


class Ids:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in self.special}
        new = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.full = new("plain", PLAIN).encode_ordinary, new("full", PATTERN).encode_ordinary
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = max([*ranks.values(), *self.special.values()]) + 1

    def encode(self, text: str) -> list[int]:
        """A special token's string inside the text gives that token, as by the library."""
        if self.cut is not None and any(s in text for s in self.special):
            return [i for p in self.cut.split(text) if p for i in ([self.special[p]] if p in self.special else self.encode(p))]
        return self.full(text) if _RUN.search(text) else self.plain(text)

    def packed(self, text: str, end: int | None = None) -> bytes:
        """Little-endian unsigned 32-bit ids, with an end id if one is given."""
        ids = self.encode(text)
        if end is not None:
            ids.append(end)
        return array("I", ids).tobytes()


_MADE: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _MADE:
        _MADE[path] = Ids(path)
    return _MADE[path]
