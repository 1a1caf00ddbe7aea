"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes words that no piece of the vocabulary can cross: cuts stand where a space mark
follows something else, and, in long words, between two characters that stand side by side in no
piece. The words of a batch lie in one flat numpy array of symbols. A round looks up the rank of
every pair of neighbours, takes the smallest of each word by a segmented minimum, merges all pairs
of that rank in the word at once (of overlapping ones every other, from the left), and compacts the
arrays. Words without a pair leave; rounds end when none is left.

The library merges one pair at a time, so a merge may open a better pair before the next of equal
rank is reached. A word where that could happen (two merges or more in one round, and one of them
makes a pair that is no worse) is merged one pair at a time from a heap instead; both give the
library's ids. Each different word is merged once and kept for a while.

The file's normaliser must be the identity with a space mark in front, without word-suffix marks;
others, and other models than BPE, are refused with an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Symbols of characters that are no piece lie above the vocabulary, by code point.
_CHARS = 0x110000
_NONE = np.iinfo(np.int32).max
#: Words above this are cut between characters that no piece joins, and are not kept; merged words
#: kept at a time; symbols merged in one go.
LONG, KEEP, FLAT = 48, 600_000, 1 << 18
#: Kinds of pieces in the file.
_UNKNOWN, _CONTROL, _USER, _BYTE = 2, 3, 4, 6


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        rules, made = model.normalizer_spec, model.trainer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if made.model_type != 2 or made.treat_whitespace_as_suffix or not plain or any(p.type == _USER for p in model.pieces):
            raise ValueError("only BPE models with identity normalisation and a leading space mark are supported")
        self.size = len(model.pieces)
        self.kind = [p.type for p in model.pieces]
        self.text_of = [p.piece for p in model.pieces]
        self.begin, self.end = self.text_of.index(made.bos_piece), self.text_of.index(made.eos_piece)
        self.id_of = {p: i for i, p in enumerate(self.text_of) if self.kind[i] not in (_UNKNOWN, _CONTROL, _BYTE)}
        self.unknown = self.kind.index(_UNKNOWN)
        self.byte_ids = [i for i, k in enumerate(self.kind) if k == _BYTE] if made.byte_fallback else []
        scores = sorted({model.pieces[i].score for i in self.id_of.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.joined: set[str] = set()
        pairs: dict[int, int] = {}
        for p, i in self.id_of.items():
            self.joined.update(map("".join, zip(p, p[1:])))
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a * (self.size + _CHARS) + b] = i
        if any(x[0] != MARK and x[1] == MARK for x in self.joined):
            raise ValueError("a piece has a space mark inside")
        self.codes = np.array(sorted(pairs), np.int64)
        self.merged_id = np.array([pairs[c] for c in self.codes.tolist()], np.int64)
        self.merged_rank = np.array([place[model.pieces[i].score] for i in self.merged_id.tolist()], np.int32)
        self.pairs = {c: (r, i) for c, r, i in zip(self.codes.tolist(), self.merged_rank.tolist(), self.merged_id.tolist())}
        self.symbol_of = np.arange(self.size, self.size + _CHARS)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.kept: dict[str, bytes] = {}
        self.byte_of = {i: n for n, i in enumerate(self.byte_ids)}
        #: An ASCII byte is a character whatever stands beside it; the others are read in runs.
        self.high = {i for i, n in self.byte_of.items() if n > 127}
        self.surface = [b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else bytes([self.byte_of[i]]) if k == _BYTE else t.replace(MARK, " ").encode() for i, (t, k) in enumerate(zip(self.text_of, self.kind))]

    def symbol(self, s: str) -> int | None:
        """The id of a piece, a number above all ids for another character, None for other strings."""
        found = self.id_of.get(s)
        return found if found is not None else self.size + ord(s) if len(s) == 1 else None

    # -- words ------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """Parts that no piece crosses. A part without a mark in front stands for one with a single
        mark, so that most texts need only be split at spaces."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] if w[1:2] not in ("", MARK) else w for w in _WORDS.findall(MARK + text.replace(" ", MARK))]

    def cut(self, word: str) -> Iterator[str]:
        at = 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                yield word[at:i]
                at = i
        yield word[at:]

    def by_word(self, sym: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        """Little-endian ids of each word, from symbols in any order of words; characters that are
        no piece become their bytes, or the unknown id."""
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        other = np.flatnonzero(sym >= self.size)
        if len(other):
            raw = [list(chr(s - self.size).encode()) if self.byte_ids else [] for s in sym[other].tolist()]
            size = np.ones(len(sym), np.int64)
            size[other] = [len(x) or 1 for x in raw]
            ids, word = np.repeat(sym, size), np.repeat(word, size)
            ids[np.repeat(sym >= self.size, size)] = [self.byte_ids[b] for x in raw for b in x] if self.byte_ids else self.unknown
        else:
            ids = sym
        ends = 4 * np.cumsum(np.bincount(word, minlength=n))
        flat = ids.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    # -- merge rounds -------------------------------------------------------------------------
    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what the symbols a and b make; _NONE where they make no piece."""
        code = a * (self.size + _CHARS) + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        there = self.codes[at] == code
        return np.where(there, self.merged_rank[at], _NONE), self.merged_id[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        sym = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, made = self.ranks(sym, np.append(sym[1:], 0))
        rank[np.flatnonzero(np.diff(word, append=-1))] = _NONE  # a word's last symbol has no right neighbour
        over: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            new_word = np.diff(word, prepend=-1) != 0
            starts, of = np.flatnonzero(new_word), np.cumsum(new_word) - 1  # of: place among the words left
            least = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero((rank == least[of]) & (rank != _NONE))
            # in a run of overlapping pairs every other is merged, from the left
            k = np.arange(len(at))
            first = np.diff(at, prepend=-2) != 1
            at = at[(k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 0]
            done = least == _NONE
            slow = self.opens_better(sym, of, at, made, rank, len(starts))
            for w in np.flatnonzero(slow).tolist():
                lo, hi = starts[w], starts[w + 1] if w + 1 < len(starts) else len(sym)
                symbols = self.one_by_one(sym[lo:hi].tolist())
                over.append((np.array(symbols), np.full(len(symbols), word[lo])))
            out = done[of]
            over.append((sym[out], word[out]))
            stay = ~(out | slow[of])
            at = at[stay[at]]
            sym[at] = made[at]
            rank[at] = _NONE  # until it is looked up again
            stay[at + 1] = False
            sym, word, rank, made, at = sym[stay], word[stay], rank[stay], made[stay], (np.cumsum(stay) - 1)[at]
            if len(at):  # only pairs that hold a merged symbol have changed
                before = at[at > 0] - 1
                at = np.union1d(at, before[word[before] == word[before + 1]])
                at = at[np.append(word[1:] == word[:-1], False)[at]]
                rank[at], made[at] = self.ranks(sym[at], sym[at + 1])
        return self.by_word(*map(np.concatenate, zip(*over)), len(words)) if over else []

    def opens_better(self, sym: np.ndarray, of: np.ndarray, at: np.ndarray, made: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
        """For each word, whether one of its several merges makes a pair that is no worse than the
        merged ones. From left to right: the left neighbour may be merged already, the right not."""
        slow = np.zeros(n, bool)
        many = np.bincount(of[at], minlength=n) > 1 if len(at) else slow
        at = at[many[of[at]]]
        if not len(at):
            return slow
        new = made[at]
        touching = np.append(False, at[:-1] + 2 == at[1:])
        left = np.where(touching, np.append(0, new[:-1]), sym[at - 1])
        has_left = (at > 0) & (of[at - 1] == of[at])
        right_at = np.minimum(at + 2, len(sym) - 1)
        has_right = (at + 2 < len(sym)) & (of[right_at] == of[at])
        worse = (np.where(has_left, self.ranks(left, new)[0], _NONE) > rank[at]) & (np.where(has_right, self.ranks(new, sym[right_at])[0], _NONE) > rank[at])
        slow[of[at[~worse]]] = True
        return slow

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """Best pair first, the leftmost of equals, over a linked list."""
        n, base = len(symbols), self.size + _CHARS
        sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        waits: list[tuple[int, int, int, int, int]] = []

        def wait(i: int, j: int) -> None:
            found = self.pairs.get(sym[i] * base + sym[j])
            if found:
                heapq.heappush(waits, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            wait(i, i + 1)
        while waits:
            _, i, a, b, new = heapq.heappop(waits)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:  # one of the two has been merged since
                continue
            sym[i], sym[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                wait(i, after[i])
            if before[i] >= 0:
                wait(before[i], i)
        return [s for s in sym if s >= 0]

    # -- texts ------------------------------------------------------------------------------
    def encode_batch(self, texts: list[str], ends: bool = True) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, with begin and end ids
        if wanted."""
        first, last = (array("I", [x]).tobytes() if ends else b"" for x in (self.begin, self.end))
        if len(self.kept) > KEEP:
            self.kept.clear()
        split = [self.words(t) for t in texts]
        found = [list(map(self.kept.get, words)) for words in split]
        new = list({w for words, ids in zip(split, found) if None in ids for w, x in zip(words, ids) if x is None})
        marked = [w if w[:1] == MARK else MARK + w for w in new]
        parts = [[w] if len(w) <= LONG else list(self.cut(w)) for w in marked]
        flat = [p for ps in parts for p in ps]
        done: list[bytes] = []
        while len(done) < len(flat):
            to, size = len(done) + 1, len(flat[len(done)])
            while to < len(flat) and size + len(flat[to]) <= FLAT:
                size += len(flat[to])
                to += 1
            done += self.merge(flat[len(done) : to])
        each = iter(done)
        here = {w: b"".join(islice(each, len(ps))) for w, ps in zip(new, parts)}
        self.kept.update((w, ids) for w, ids in here.items() if len(w) <= LONG)
        for words, ids in zip(split, found):
            if None in ids:
                ids[:] = [here[w] if x is None else x for w, x in zip(words, ids)]
        return [first + b"".join(ids) + last for ids in found]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): control ids are invisible, the space mark in front goes,
        runs of byte ids are read as UTF-8."""
        out = list(map(self.surface.__getitem__, ids))
        first = next((k for k, i in enumerate(ids) if self.kind[i] != _CONTROL), 0)
        if ids and self.kind[ids[first]] not in (_BYTE, _UNKNOWN) and out[first][:1] == b" ":
            out[first] = out[first][1:]
        if self.high.isdisjoint(ids):
            return b"".join(out).decode()
        k = 0
        while k < len(ids):
            to = k
            while to < len(ids) and ids[to] in self.high:
                to += 1
            if to > k:
                out[k:to] = [utf8(b"".join(out[k:to])), *[b""] * (to - k - 1)]
            k = to + 1
        return b"".join(out).decode()


def utf8(raw: bytes) -> bytes:
    """The bytes with each one that begins no valid character replaced."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in range(1, 5):
            try:
                raw[i : i + n].decode()
                out.append(raw[i : i + n])
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


_MADE: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MADE:
        _MADE[path] = Pieces(path)
    return _MADE[path]


def _parts(column: pa.Array, rows: int = 256, chars: int = 1 << 22) -> Iterator[list[str]]:
    """The texts of a column in lists of bounded rows and, but for one long text, characters."""
    part: list[str] = []
    size = 0
    for x in column:
        t = x.as_py() or ""
        if part and (len(part) == rows or size + len(t) > chars):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ends: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of each row; null text is empty.

    One row for each row of df, repeated and null ids included; other columns are left out."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            at = 0
            for part in _parts(b.column(1)):
                ids = [array("i", raw).tolist() if raw else [] for raw in model.encode_batch(part, ends)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
                at += len(part)

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text for rows of encode_documents; null ids decode to null."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            texts = [None if x.as_py() is None else model.decode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids of each text and of the text decoded from those ids, in one pass, so that
    ids need not leave the worker: doc_id, n_tokens (with begin and end ids), ids_sha256 (of
    little-endian unsigned 32-bit ids) and decoded_sha256. Null text is taken as empty."""
    kind = df.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            at = 0
            for part in _parts(b.column(1)):
                raw = model.encode_batch(part)
                n = [len(x) // 4 for x in raw]
                sha = [hashlib.sha256(x).hexdigest() for x in raw]
                back = [hashlib.sha256(model.decode(array("I", x).tolist()).encode()).hexdigest() for x in raw]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names)
                at += len(part)

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_pieces_round_trip(spark, sf_dir: str) -> DataFrame:
    """round_trip of the whole documents table. Null and empty texts have the begin and end ids
    alone; repeated rows, null ids and empty tables pass as they are."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
