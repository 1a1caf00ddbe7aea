"""Ranked lexical search: best-first document intervals over posting lists with range-maximum tables.

1. The terms of all queries are hashed into a bitmap of fixed size, which goes to every task. One
   pass over the texts counts terms; those in the bitmap become posting lists of segments of some
   thousand documents, one row each, written to the shared folder. No posting is shuffled, so a
   term that every document holds is dealt like any other.
2. Document frequencies, the number of documents and their length are sums over the segments. Terms
   that only share a bit with a query's term fall away in the join that weighs the queries' terms.
3. Queries go to the segments in blocks of checked size. In a segment every list gets a sparse table
   of the places of its range maxima (all lists at once: a level is one numpy comparison). The sum
   of a query's range maxima bounds every document of an interval. The intervals of highest bound
   are split at the document of their largest single impact, which is scored exactly; intervals
   bounded below the k-th score found go. What a task has found in one segment is its threshold in
   the next.
4. The best k of each task meet in one ranking.

All weights and scores are 64-bit integers but for the logarithm in a weight.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Bits of the map of query terms; documents and postings of a segment; entries (term and weight)
#: of a block of queries; intervals split at a time.
BITS, SEGMENT, POSTINGS, BLOCK, BATCH = 1 << 22, 8192, 1 << 19, 1 << 18, 24
_TERM = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Separators become spaces, A-Z lower case; bytes of other characters stay.
_PLAIN = bytes(c if c > 127 or c in _TERM else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of 0-9, A-Z, a-z and all characters above U+007F, only A-Z lower-cased."""
    return (text or "").encode().translate(_PLAIN).split()


# -- queries ------------------------------------------------------------------------------------
def asked(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (a key of id and text), item_id, term and n (its times in the text) of each item."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                found = Counter(terms(t.as_py()))
                if found:
                    key = f"{i}:{hashlib.sha256((t.as_py()).encode()).hexdigest()}"
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(found)), pa.array([i.as_py()] * len(found), b.column(0).type), pa.array([x.decode() for x in found]), pa.array(list(found.values()), pa.int64())],
                        ["item", "item_id", "term", "n"],
                    )

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(run, f"item string, item_id {kind}, term string, n long")


def bitmap(wanted: DataFrame, bits: int) -> np.ndarray:
    """A flag for each value of crc32 modulo bits that a term has: at most bits / 32 rows come."""
    place = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(bits)).cast("int")
    words = wanted.select(place.alias("p")).groupBy((F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p % 32)")).alias("x"))
    out = np.zeros(-(-bits // 32), np.uint32)
    for w, x in words.collect():
        out[w] = x
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


# -- index --------------------------------------------------------------------------------------
class Segment:
    """Documents and their postings until they become a row."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.number: dict[bytes, int] = {}
        self.term: list[int] = []
        self.count: list[int] = []
        self.held: list[int] = []
        self.docs = self.total = 0

    def add(self, doc_id, n: int, found: list[tuple[bytes, int]]) -> None:
        self.docs += 1
        self.total += n
        if found:
            number = self.number
            self.term += [number.setdefault(x, len(number)) for x, _ in found]
            self.count += [c for _, c in found]
            self.held.append(len(found))
            self.ids.append(doc_id)
            self.sizes.append(n)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT or len(self.term) >= POSTINGS

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        order = np.argsort(np.array(self.term, np.int64), kind="stable")
        at = np.repeat(np.arange(len(self.held)), self.held)[order]
        lengths = np.bincount(self.term, minlength=len(self.number)) if self.term else np.zeros(0, np.int64)
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs], pa.int64()), pa.array([self.total], pa.int64()), one(self.ids, kind), one(self.sizes, pa.int64()),
                one([x.decode() for x in self.number], pa.string()), one(lengths, pa.int32()), one(at, pa.int32()), one(np.array(self.count, np.int64)[order], pa.int64()),
            ],
            ["docs", "total", "ids", "sizes", "terms", "lengths", "at", "tf"],
        )


def index(docs: DataFrame, flags: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """A row for each segment: docs and total (documents with a term, and all their terms), ids and
    sizes (terms) of the documents that hold a wanted term, terms and lengths of their lists, and
    the lists end to end: at (places in ids, ascending) and tf."""
    kind = docs.schema[doc_id].dataType.simpleString()
    bits = len(flags)
    packed = np.packbits(flags).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.unpackbits(np.frombuffer(packed, np.uint8))[:bits]
        known: dict[bytes, bool] = {}
        seg = Segment()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                words = terms(t.as_py())
                if not words:
                    continue
                if len(known) > 500_000:
                    known.clear()
                counts = Counter(words)
                found = []
                for x, c in counts.items():
                    hit = known.get(x)
                    if hit is None:
                        hit = known[x] = bool(here[zlib.crc32(x) % bits])
                    if hit:
                        found.append((x, c))
                seg.add(i.as_py(), len(words), found)
                if seg.full():
                    yield seg.row(b.column(0).type)
                    seg = Segment()
            kind_here = b.column(0).type
        if seg.docs:
            yield seg.row(kind_here)

    return docs.select(doc_id, text).mapInArrow(run, f"docs long, total long, ids array<{kind}>, sizes array<long>, terms array<string>, lengths array<int>, at array<int>, tf array<long>")


# -- search -------------------------------------------------------------------------------------
class Lists:
    """The posting lists of a segment with a sparse table of range maxima over all of them."""

    def __init__(self, sizes: np.ndarray, names: list[str], lengths: np.ndarray, at: np.ndarray, tf: np.ndarray, n: int, total: int):
        self.width = len(sizes) + 1
        m = 75 + (25 * sizes * n) // total
        self.at, self.impact = at.astype(np.int64), (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])
        ends = np.cumsum(lengths)
        self.place = {x: k for k, x in enumerate(names)}
        self.start, self.stop = ends - lengths, ends
        #: Ascending over all lists, so a document is found in any list by one search.
        self.key = np.repeat(np.arange(len(lengths)), lengths) * self.width + self.at
        self.levels = [np.arange(len(at), dtype=np.int32)]
        while 2 << (len(self.levels) - 1) <= lengths.max(initial=0):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            a, b = last[:-step], last[step:]
            self.levels.append(np.where(self.impact[b] > self.impact[a], b, a))
        #: Rows of one table, so that a lookup takes level and place at once; row ends are never read.
        self.table = np.zeros((len(self.levels), max(1, len(at))), np.int32)
        for k, x in enumerate(self.levels):
            self.table[k, : len(x)] = x
        del self.levels
        self.log = np.zeros(int(lengths.max(initial=0)) + 2, np.int64)
        for k in range(2, len(self.log)):
            self.log[k] = self.log[k >> 1] + 1

    def best(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the largest impact of lo:hi stands; lo for empty ranges."""
        k = self.log[np.maximum(hi - lo, 1)]
        lo = np.minimum(lo, self.table.shape[1] - 1)
        a, b = self.table[k, lo], self.table[k, np.maximum(hi - (1 << k), 0)]
        return np.where(self.impact[b] > self.impact[a], b, a)


class Found:
    """The best k of a query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """Documents below this are out; equal scores may still win by their id."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], ids: list) -> None:
        self.rows = sorted(self.rows + [(-s, i is None, i) for s, i in zip(scores, ids)], key=lambda x: x if not x[1] else (x[0], True, 0))[: self.k]


def search(lists: Lists, ids: list, wanted: list[tuple[str, int]], found: Found, batch: int = BATCH) -> int:
    """Add the segment's best documents for one query (terms and weights) to found. Gives the number
    of intervals split."""
    mine = [(lists.place[x], w) for x, w in wanted if x in lists.place]
    if not mine:
        return 0
    which, weight = np.array([x for x, _ in mine]), np.array([w for _, w in mine], np.int64)
    base = which * lists.width

    def measured(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound and split document of each interval (rows: intervals, columns: lists)."""
        top = lists.best(lo, hi)
        gain = np.where(hi > lo, weight * lists.impact[top], 0)
        rows = np.arange(len(lo))
        return gain.sum(1), lists.at[top[rows, gain.argmax(1)]]

    lo, hi = lists.start[which][None, :], lists.stop[which][None, :]
    bound, doc = measured(lo, hi)
    split = 0
    while len(bound):
        if len(bound) > batch:
            order = np.argpartition(-bound, batch)
            now, later = order[:batch], order[batch:]
        else:
            now, later = np.arange(len(bound)), np.zeros(0, np.int64)
        a, z, d = lo[now], hi[now], doc[now]
        mid = np.searchsorted(lists.key, base + d[:, None])
        there = (mid < z) & (lists.at[np.minimum(mid, len(lists.at) - 1)] == d[:, None])
        scores = np.where(there, weight * lists.impact[np.minimum(mid, len(lists.at) - 1)], 0).sum(1)
        split += len(now)
        good = scores >= found.floor
        if good.any():
            found.add(scores[good].tolist(), [ids[x] for x in d[good].tolist()])
        a, z = np.concatenate([a, mid + there]), np.concatenate([mid, z])
        b, d = measured(a, z)
        floor = found.floor
        new, old = b >= floor, later[bound[later] >= floor]
        lo, hi = np.concatenate([lo[old], a[new]]), np.concatenate([hi[old], z[new]])
        bound, doc = np.concatenate([bound[old], b[new]]), np.concatenate([doc[old], d[new]])
    return split


def searched(made: DataFrame, block: list[tuple], n: int, total: int, k: int, item_kind: str, doc_kind: str) -> DataFrame:
    """item, item_id, doc_id and score of each task's best; block: item, item_id, terms, weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Found(k) for _ in block]
        id_kind = None
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                flat = lambda c: row.column(c).flatten()
                id_kind = flat("ids").type
                ids = flat("ids").to_pylist()
                lists = Lists(*(flat(c).to_numpy(zero_copy_only=False) if c != "terms" else flat(c).to_pylist() for c in ("sizes", "terms", "lengths", "at", "tf")), n, total)
                for (_, _, names, weights), found in zip(block, best):
                    search(lists, ids, list(zip(names, weights)), found)
        for (item, item_id, _, _), found in zip(block, best):
            if found.rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found.rows)), pa.array([item_id] * len(found.rows), item_type), pa.array([i for _, _, i in found.rows], id_kind), pa.array([-s for s, _, _ in found.rows], pa.int64())],
                    ["item", "item_id", "doc_id", "score"],
                )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    item_type = to_arrow_type(StructType.fromDDL(f"x {item_kind}")[0].dataType)
    return made.select("ids", "sizes", "terms", "lengths", "at", "tf").mapInArrow(run, f"item string, item_id {item_kind}, doc_id {doc_kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, ties to smaller ids.

    Every row of docs is a document, repeated rows and rows of null id (last among ties) too; null
    and empty texts have no terms. Different texts under one item_id are answered each on its own,
    whole repeated items once; items without terms get no rows. Other columns are left out."""
    wanted = stored(asked(items, item_id, text), "asked-terms")
    item_kind, doc_kind = wanted.schema["item_id"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    made = stored(index(docs, bitmap(wanted, BITS), doc_id, text), "segments", **{"parquet.block.size": str(16 << 20)})
    n, total = made.agg(F.sum("docs"), F.sum("total")).first()
    weighted = stored(weights(made, wanted, n or 0), "weighted-items")
    blocks, size = 1, weighted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    block_of = lambda b: F.pmod(F.xxhash64("item"), F.lit(b))
    while True:  # until no block is over the bound, or it holds one item
        most = weighted.groupBy(block_of(blocks).alias("b")).agg(F.sum(F.size("terms")).alias("s"), F.count("*").alias("c")).where((F.col("s") > 2 * BLOCK) & (F.col("c") > 1))
        if most.isEmpty():
            break
        blocks *= 2
    parts = [searched(made, [tuple(r) for r in weighted.where(block_of(blocks) == b).collect()], n, total, k, item_kind, doc_kind) for b in range(blocks if size else 0)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], f"item string, item_id {item_kind}, doc_id {doc_kind}, score long")
    for p in parts[1:]:
        out = out.union(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def weights(made: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """item, item_id, terms and weights (times the term's number in the item) of each item; terms
    that no document holds, and weights of zero, are left out."""
    df = made.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.lengths").alias("df"))
    w = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1).cast("double")))
    rows = wanted.join(df, "term").withColumn("w", F.col("n") * w).where("w > 0")
    return rows.groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("item", "item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """ranked over the whole documents and benchmark tables: item_id, rank, doc_id, score."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
