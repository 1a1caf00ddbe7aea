"""Packing examples into fixed-length sequences by vector bin packing.

An example asks for three things at once: tokens, segments (one for each piece) and loss-bearing
tokens; a sequence has a limit on each. The dot-product heuristic fills one sequence at a time:
of the waiting examples that fit, the one whose demand has the largest weighted dot product with
what is left of the sequence goes in, weights being the mean demand of those that wait. When none
fits, one is cut to fill the sequence to its last token; the rest of it waits again.

Each task packs what it reads, in windows of WINDOW examples, so there is no shuffle and memory
does not grow with the input. What a task has left at the end is cut into sequences whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table

WINDOW = 1024
CAPACITY, SEGMENTS = 1024, 256


class Packer:
    """Limits are positive. An item is a row (example, start, length, prompt): tokens of the
    example from start, of which those before prompt bear no loss."""

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None):
        if capacity < 1 or segments < 1 or (loss is not None and loss < 1):
            raise ValueError("limits must be positive")
        self.limit = np.array([capacity, segments, loss if loss is not None else capacity], float)
        self.items = np.zeros((0, 4), np.int64)
        self.out: list[list[tuple[int, int, int]]] = []

    @staticmethod
    def demand(items: np.ndarray) -> np.ndarray:
        start, length, prompt = items[:, 1], items[:, 2], items[:, 3]
        bearing = np.clip(start + length - np.maximum(start, prompt), 0, length)
        return np.stack([length, np.ones(len(items)), bearing], 1) / 1.0

    def add(self, example: int, length: int, prompt: int = 0) -> None:
        """Whole sequences of a long example need no search; what remains waits."""
        start, cap = 0, int(self.limit[0])
        if self.limit[2] >= cap:
            for start in range(0, length - cap + 1, cap):
                self.out.append([(example, start, cap)])
            start = length // cap * cap
        if start < length:
            self.wait.append((example, start, length - start, prompt))

    wait: list

    def begin(self) -> None:
        self.wait = []

    def cut_to(self, item: np.ndarray, left: np.ndarray) -> int:
        """How many tokens of the item fit into what is left."""
        free = max(0, item[3] - item[1])  # tokens without loss come first
        return int(min(item[2], left[0], free + left[2]))

    def fill(self, down_to: int, last: bool = False) -> None:
        """Make sequences until at most down_to items wait."""
        items = np.concatenate([self.items, np.array(self.wait, np.int64).reshape(-1, 4)])
        self.wait = []
        need = self.demand(items) / self.limit
        alive = np.ones(len(items), bool)
        while alive.sum() > down_to:
            weight = need[alive].mean(0)
            left, box = np.ones(3), []
            while left[0] > 1e-9 and left[1] > 1e-9 and alive.any():
                score = need @ (weight * left)
                fits = alive & (need <= left + 1e-9).all(1)
                exact = np.rint(left * self.limit)
                if exact[1] == 1:  # the last segment has to close the sequence
                    fits &= items[:, 2] >= exact[0]
                if fits.any():
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    box.append((int(items[k, 0]), int(items[k, 1]), int(items[k, 2])))
                    left = left - need[k]
                    alive[k] = False
                    continue
                k = int(np.argmax(np.where(alive, score, -1.0)))
                n = self.cut_to(items[k], exact)
                if n <= 0:
                    others = [self.cut_to(items[i], exact) if alive[i] else 0 for i in range(len(items))]
                    k = int(np.argmax(others))
                    n = others[k]
                    if n <= 0:
                        break
                box.append((int(items[k, 0]), int(items[k, 1]), n))
                part = np.array([[items[k, 0], items[k, 1], n, items[k, 3]]])
                left = left - self.demand(part)[0] / self.limit
                if n == items[k, 2]:
                    alive[k] = False
                else:
                    items[k, 1] += n
                    items[k, 2] -= n
                    need[k] = self.demand(items[k : k + 1])[0] / self.limit
            self.close(box)
        self.items = items[alive]

    def close(self, box: list[tuple[int, int, int]]) -> None:
        """A sequence that is not full is cut at powers of two."""
        total = sum(x[2] for x in box)
        if total == self.limit[0]:
            self.out.append(box)
            return
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            part = []
            while room:
                example, start, length = box[0]
                n = min(room, length)
                part.append((example, start, n))
                box = box[1:] if n == length else [(example, start + n, length - n), *box[1:]]
                room -= n
            self.out.append(part)


def pack(
    df: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    prompt: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
    segments: int = SEGMENTS,
    loss: int | None = None,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text (null: empty) is its ids and then end_id, so that every row takes part, repeated
    rows and null ids too. prompt names a column with how many first tokens bear no loss (null:
    none). segments limits the pieces of a sequence, loss its loss-bearing tokens (None: no limit
    below capacity). sequence_id is the task's number and a count within it; an empty table gives
    no rows. Other columns of df are left out."""
    from pyspark.sql import functions as F

    kind = df.schema[doc_id].dataType.simpleString()
    first = F.coalesce(F.col(prompt), F.lit(0)) if prompt else F.lit(0)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .chunk_ids import ids_of

        ids = ids_of(path)
        packer, base, made = Packer(capacity, segments, loss), TaskContext.get().partitionId() << 33, 0
        packer.begin()
        held: dict[int, list] = {}  # example -> id, ids, tokens not yet given out
        id_type = None

        def given() -> pa.RecordBatch:
            nonlocal made
            rows = []
            for box in packer.out:
                at = 0
                for example, start, length in box:
                    name, raw, left = held[example]
                    rows.append((name, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, base + made, at))
                    at += length
                    held[example][2] = left - length
                    if left == length:
                        del held[example]
                made += 1
            packer.out = []
            cols = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        n = 0
        for b in batches:
            id_type = b.schema.field(0).type
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                for name, t, p in zip(*(part.column(i).to_pylist() for i in range(3))):
                    raw = ids.packed(t or "", end_id)
                    held[n] = [name, raw, len(raw) // 4]
                    packer.add(n, len(raw) // 4, max(0, p))
                    n += 1
                if len(packer.wait) + len(packer.items) >= WINDOW:
                    packer.fill(WINDOW // 2)
                if packer.out:
                    yield given()
        packer.fill(0, last=True)
        if packer.out:
            yield given()

    spec = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return df.select(doc_id, text, first.cast("long").alias("prompt")).mapInArrow(run, spec)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """pack for the whole documents table, without prompts and loss limit; nulls, empty and long
    texts, repeated rows and empty tables as stated there."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
