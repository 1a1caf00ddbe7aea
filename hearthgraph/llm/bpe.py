"""Byte-level BPE encoding and decoding as a monoid: halves are encoded on their own and joined.

A text is halved down to leaves of LEAF characters at most, so that all but the shortest texts are
joined from several; a library encodes the leaves. Two neighbours are joined by encoding a window around the seam again. The window grows, in doubling steps, until
both its ends are sure boundaries of the split into pieces (a space after a non-space, or an end
of the two halves); tokens outside cannot change then, so they are kept as they are.

A piece longer than LEAF bytes (one that has no boundary inside) is halved by bytes, its leaves are
merged here (the library takes no bytes). There the window grows token by token until the pairs of tokens over both its ends are stable, that is,
encoding the two together gives the same two. A sequence all of whose neighbouring pairs are
stable is the encoding of the whole, so nothing outside the window can change.

Decoding concatenates the bytes of halves up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _SYNC, table
from .token_counts import PATTERN

LEAF = 160


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern).findall
        self.leaf = leaf
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.text_of = list(map(str, range(size)))
        self.stable_pairs: dict[tuple[int, int], bool] = {}

    # -- pieces without a boundary inside ---------------------------------------------------
    def stable(self, a: int, b: int) -> bool:
        got = self.stable_pairs.get((a, b))
        if got is None:
            if len(self.stable_pairs) > 1_000_000:
                self.stable_pairs.clear()
            got = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.stable_pairs[a, b] = got
        return got

    def merged(self, raw: bytes) -> list[int]:
        """Merges by rank, the leftmost of equals first, over a linked list of parts."""
        n, ranks = len(raw), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(waits)
        while waits:
            _, i, to = heapq.heappop(waits)
            j = end[i] and after[i]
            if not j or j >= n or end[j] != to:  # one of the two has been merged since
                continue
            end[i], after[i], end[j] = to, after[j], 0
            if after[i] < n:
                before[after[i]] = i
                self.wait(waits, raw, i, end[after[i]])
            if before[i] >= 0:
                self.wait(waits, raw, before[i], to)
        return [ranks[raw[i : end[i]]] for i in range(n) if end[i]]

    def wait(self, waits: list, raw: bytes, i: int, to: int) -> None:
        rank = self.ranks.get(raw[i:to])
        if rank is not None:
            heapq.heappush(waits, (rank, i, to))

    def join_bytes(self, a: list[int], b: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.decode(a[len(a) - i :] + b[:j])
            whole = i == len(a) and j == len(b)
            # one that has grown past any leaf is halved as well, unless it is all there is
            mid = self.merged(window) if whole or len(window) <= 4 * self.leaf else self.piece(window)
            left = i == len(a) or self.stable(a[len(a) - i - 1], mid[0])
            right = j == len(b) or self.stable(mid[-1], b[j])
            if left and right:
                return a[: len(a) - i] + mid + b[j:]
            i, j = (i if left else 2 * i), (j if right else 2 * j)

    def piece(self, raw: bytes) -> list[int]:
        if len(raw) <= self.leaf:
            return self.merged(raw)
        half = len(raw) // 2
        return self.join_bytes(self.piece(raw[:half]), self.piece(raw[half:]))

    # -- texts ------------------------------------------------------------------------------
    def window(self, text: str) -> list[int]:
        """A text that begins and ends at boundaries."""
        if len(text) <= self.leaf:
            return self.lib.encode_ordinary(text)
        out: list[int] = []
        for p in self.find(text):
            out += self.piece(p.encode()) if len(p) > self.leaf else self.lib.encode_ordinary(p)
        return out

    def seam(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """The ends of the smallest window, in doubling steps, that no later text can move."""
        w = 16
        left = right = None
        while left is None or right is None:
            if left is None:
                at = max(lo, mid - w)
                found = [m.start() for m in _SYNC.finditer(text, at, mid)]
                left = found[-1] if found else lo if at == lo else None
            if right is None:
                to = min(hi, mid + w)
                found = next(_SYNC.finditer(text, mid + 1, to), None)
                right = found.start() if found else hi if to == hi else None
            w *= 2
        return left, right

    def skip(self, ids: list[int], n: int, back: bool) -> int:
        """How many tokens at the end (back) or the start of ids make n bytes."""
        k = 0
        for i in reversed(ids) if back else ids:
            if n <= 0:
                break
            n -= len(self.bytes_of[i])
            k += 1
        assert n == 0, "a boundary inside a token"
        return k

    def join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        left, right = self.seam(text, lo, mid, hi)
        i = len(a) if left == lo else self.skip(a, len(text[left:mid].encode()), True)
        j = len(b) if right == hi else self.skip(b, len(text[mid:right].encode()), False)
        return a[: len(a) - i] + self.window(text[left:right]) + b[j:]

    def encode(self, text: str, lo: int = 0, hi: int | None = None) -> list[int]:
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self.lib.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.encode(text, lo, mid), self.encode(text, mid, hi))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_MADE: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _MADE:
        _MADE[path] = Encoder(path)
    return _MADE[path]


def encode_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row; null text is empty and has no ids.

    One row for each row of df, repeated and null ids included; other columns are left out."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [enc.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text (binary) for rows of encode_documents; null ids decode to null."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            raw = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text binary")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids of each text and of the bytes decoded from those ids.

    One pass, so that ids need not leave the worker: doc_id, n_tokens, ids_sha256 (of decimal
    ids joined by commas) and decoded_sha256. Null text is taken as empty."""
    kind = df.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n, sha, back = [], [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(enc.text_of.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names)

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """round_trip of the whole documents table. Null and empty texts have no ids (the digests of
    nothing); repeated rows, null ids and empty tables pass as they are."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
