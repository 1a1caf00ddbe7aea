"""Token counts by a compiled finite-state tokenizer.

A byte pair tokenizer is turned into a deterministic transducer whose transitions carry the
change of the token count. Its states are made when first reached and kept: a state is the
longest suffix of the piece that some token begins with, and for each cut inside that suffix
the last token before the cut and how many tokens fewer (or more) the text up to the cut has.
That is all that any continuation can depend on: a token that ends later begins in the suffix,
and a sequence of tokens is the tokenizer's own exactly if each neighbouring pair is.

Over it stands a transducer of characters, whose states also hold which alternative of the
pattern is open. Every text is read in chunks of CHUNK characters. What a chunk does is a map from
entry state to exit state and number of tokens: whatever the entry, the state after the first
sure boundary is the same, so the map is the head before it (read from any state when asked), one
count and one exit state. Maps compose, and a prefix scan over a text's chunks gives the count of
every prefix in as many steps as the logarithm of their number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import parts, table

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 512
#: Entries kept by a worker at most; when full, it starts again. Bounds memory, not results.
KEEP = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts tokens of pieces, byte by byte, with states made on demand."""

    def __init__(self, merges: list[tuple[bytes, bytes]], alphabet: list[bytes]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.made = {x: (-1, x, x) for x in alphabet} | {a + b: (i, a, b) for i, (a, b) in reversed([*enumerate(merges)])}
        self.tokens = set(self.made)
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        self.pairs: dict[tuple, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((None, 0),))
        self.states, self.index = [start], {start: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def encode(self, piece: bytes) -> list[bytes]:
        """The merges by rank, for pairs of tokens only: short input."""
        out = [piece[i : i + 1] for i in range(len(piece))]
        while len(out) > 1:
            best = min(zip(out, out[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            merged, i = [], 0
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == best:
                    merged.append(out[i] + out[i + 1])
                    i += 2
                else:
                    merged.append(out[i])
                    i += 1
            out = merged
        return out

    def fits(self, a: bytes | None, b: bytes) -> bool:
        """Whether b stays a token of its own after a (None: at the start of the piece)."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 4 * KEEP:
                self.pairs.clear()
            own = a is None or self.fits(None, b)
            got = self.pairs[a, b] = own and (self.encode(b) == [b] if a is None else self.meets(a, b))
        return got

    def meets(self, a: bytes, b: bytes) -> bool:
        """Whether no merge over the seam comes before those that made a and b.

        Undo the later of the two last merges again and again; what then stands at the seam was
        there until that merge, so a merge over the seam of lower rank would have come first.
        Of equal ranks the one further left comes first."""
        limit = len(self.rank)
        while self.rank.get((a, b), limit) >= limit:
            (ra, _, right), (rb, left, _) = self.made[a], self.made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, right
            else:
                limit, b = rb + 1, left
        return False

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the count; compiled at its first use."""
        seen, cuts = self.states[state]
        seen += bytes([byte])
        n = len(seen)
        for i in range(n):  # longest first
            token = seen[i:]
            if token in self.tokens and self.fits(cuts[i][0], token):
                delta = cuts[i][1] + 1
                break
        else:
            raise ValueError(f"no token ends in {seen!r}")
        cuts = (*cuts, (token, delta))
        k = next(i for i in range(n + 1) if seen[i:] in self.prefixes)
        new = (seen[k:], tuple((t, c - delta) for t, c in cuts[k:]))
        at = self.index.get(new)
        if at is None:
            at = self.index[new] = len(self.states)
            self.states.append(new)
            self.steps.append({})
        self.steps[state][byte] = at, delta
        return at, delta


class StateMap:
    """What a chunk does to any entry state: read the heads, one after the other, and then be in
    exit with so many tokens more. Without a sure boundary there is no exit of its own (None): the
    state after the heads is the exit. What a head did to a state is kept, so it is read once."""

    __slots__ = ("heads", "count", "exit")

    def __init__(self, heads: tuple[Head, ...], count: int = 0, exit_: State | None = None):
        self.heads, self.count, self.exit = heads, count, exit_

    def __call__(self, state: State) -> tuple[State, int]:
        total = self.count
        for h in self.heads:
            state, n = h(state)
            total += n
        return (state if self.exit is None else self.exit), total

    def then(self, other: StateMap) -> StateMap:
        """The map of this chunk and then the other: associative, and the heart of the scan."""
        if self.exit is None:
            return StateMap(self.heads + other.heads, self.count + other.count, other.exit)
        state, n = other(self.exit)
        return StateMap(self.heads, self.count + n, state)


class Head:
    __slots__ = ("run", "text", "seen")

    def __init__(self, run, text: str):
        self.run, self.text, self.seen = run, text, {}

    def __call__(self, state: State) -> tuple[State, int]:
        got = self.seen.get(state)
        if got is None:
            got = self.seen[state] = self.run(state, self.text)
        return got


def scan(maps: list[StateMap]) -> list[StateMap]:
    """All prefix compositions: up- and down-sweep over pairs, in as many steps as the logarithm."""
    if len(maps) < 2:
        return maps
    odd = scan([a.then(b) for a, b in zip(maps[::2], maps[1::2])])
    return [odd[i // 2] if i % 2 else odd[i // 2 - 1].then(m) if i else m for i, m in enumerate(maps)]


#: What a state has open: nothing, a piece of letters, numbers or other characters, white space
#: (its last character not yet read), an apostrophe, or an apostrophe and r, v or l (not yet read).
NOTHING, LETTERS, NUMBERS, OTHERS, SPACE, QUOTE, SHORT = range(7)
#: That, the byte pair transducer's state in the piece, and the characters not yet read.
State = tuple[int, int, str]
START, SPACED = (NOTHING, 0, ""), (SPACE, 0, " ")  # SPACED: after a sure boundary and its space


class Counter:
    """The whole tokenizer as one transducer over characters: what PATTERN has open, and where
    the byte pair transducer is in it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        split = lambda m: m.split(" ") if isinstance(m, str) else m
        merges = [tuple(map(raw, split(m))) for m in made["model"]["merges"]]
        self.machine = Transducer(merges, [bytes([b]) for b in range(256)])
        self.special = [x["content"] for x in made["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.kinds = [(regex.compile(p).match, k) for p, k in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS), (r"\s", SPACE))]
        self.kind_of: dict[str, int] = {}
        self.runs = regex.compile(r"\p{L}+|(?s:.)").findall
        self.kept: dict[str, int] = {}

    def kind(self, char: str) -> int:
        got = self.kind_of.get(char)
        if got is None:
            got = self.kind_of[char] = next((k for match, k in self.kinds if match(char)), OTHERS)
        return got

    def read(self, at: int, chars: str) -> tuple[int, int]:
        """The byte pair transducer over the characters: its state, and the change of the count."""
        steps, total = self.machine.steps, 0
        for byte in chars.encode():
            at, n = steps[at].get(byte) or self.machine.step(at, byte)
            total += n
        return at, total

    def opened(self, chars: str, kind: int) -> tuple[State, int]:
        at, n = self.read(0, chars)
        return (QUOTE if chars == "'" else kind, at, ""), n

    def next(self, state: State, char: str) -> tuple[State, int]:
        """One step of the transducer, as PATTERN's alternatives decide in their order."""
        mode, at, held = state
        kind = self.kind(char)
        if kind == SPACE:
            if mode == SPACE:
                at, n = self.read(at, held)
                return (SPACE, at, char), n
            return (SPACE, 0, char), self.read(0, held)[1]
        if mode == SPACE:  # the last white space goes with what follows if it is a blank
            if held == " ":
                at, n = self.read(0, " " + char)
                return (kind, at, ""), n
            new, n = self.opened(char, kind)
            return new, n + self.read(0, held)[1]
        if mode == SHORT:
            if char == ("l" if held == "l" else "e"):
                return (NOTHING, 0, ""), self.read(at, held + char)[1]
            at, n = self.read(0, held)
            new, more = self.next((LETTERS, at, ""), char)
            return new, n + more
        if mode == QUOTE:
            if char in "stmd":
                return (NOTHING, 0, ""), self.read(at, char)[1]
            if char in "rvl":
                return (SHORT, at, char), 0
        if kind == (OTHERS if mode == QUOTE else mode):
            at, n = self.read(at, char)
            return (kind, at, ""), n
        return self.opened(char, kind)

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for part in self.runs(text):  # letters inside a piece of letters are bytes of that piece
            for i in range(len(part)):
                if state[0] == LETTERS and len(part) > 1:
                    at, n = self.read(state[1], part[i:] if i else part)
                    state, total = (LETTERS, at, ""), total + n
                    break
                state, n = self.next(state, part[i])
                total += n
        return state, total

    def end(self, state: State) -> int:
        """What the end of the text adds: the characters that are not yet read."""
        mode, piece, held = state
        return self.read(piece if mode == SPACE else 0, held)[1]

    def word(self, word: str) -> int:
        """Tokens from a boundary to the next."""
        if word.isascii() and word.isalpha():
            return self.read(0, " " + word)[1]
        return self.run(SPACED, word + " ")[1]

    def words(self, rest: list[str]) -> int:
        """Tokens from boundary to boundary: transitions on whole words, kept when first made."""
        kept = self.kept
        for w in set(rest).difference(kept):
            if len(w) <= 64:
                kept[w] = self.word(w)
        try:
            return sum(map(kept.__getitem__, rest))
        except KeyError:
            return sum(n if (n := kept.get(w)) is not None else self.word(w) for w in rest)

    def map(self, chunk: str) -> StateMap:
        first, rest = parts(chunk)
        if not first and rest:  # the space in front: what stands before it is not known here
            first, rest = " " + rest[0], rest[1:]
        if not rest:
            return StateMap((Head(self.run, chunk),))
        last, n = self.run(SPACED, rest[-1])
        return StateMap((Head(self.run, first + " "),), self.words(rest[:-1]) + n, last)

    def prefixes(self, text: str, chunk: int | None = None) -> list[int]:
        """Tokens of the first chunk, the first two, and so on, each as a text of its own, of a
        text without special strings."""
        width = chunk or CHUNK
        if len(self.machine.states) > KEEP:
            self.machine.reset()
        if len(self.kept) > 2 * KEEP:
            self.kept.clear()
        maps = [self.map(text[i : i + width]) for i in range(0, len(text), width)]
        if maps:  # the text's start is known
            state, n = maps[0](START)
            maps[0] = StateMap((), n, state)
        return [m.count + self.end(m.exit) for m in scan(maps)]

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.special):
            pieces = self.cut.split(text)
            return sum(map(self.count, pieces)) + len(pieces) - 1
        return self.prefixes(text)[-1] if text else 0


_MADE: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker and file."""
    if path not in _MADE:
        _MADE[path] = Counter(path)
    return _MADE[path]


def token_count_udf(path: str):
    """text -> number of tokens; null text counts as empty."""
    @pandas_udf("long")
    def n_tokens(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for s in it:
            yield pd.Series([count(t) if t else 0 for t in s], dtype="int64")

    return n_tokens


def token_counts(df: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit; columns of these names are replaced.

    Null and empty text: 0, 0 and false. Rows are neither dropped nor joined, so repeated rows
    and null ids stay as they are; an empty table gives an empty table."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_count_udf(path)(F.col(text))})
    return df.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """token_counts of the whole documents table; nulls, empty and long texts, repeated rows and
    empty tables as stated there."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
