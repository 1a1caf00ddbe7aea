"""Exact top-k search by the three-phase uniform threshold.

A vector's score is a sum over LISTS slices of its components, so each slice ranks all
candidates in a list of its own, and blocks of candidates hold a part of each list, sorted by the
length of the slice (nobody's score in a list is above that length times the query's).

1. Gather: each block sends the first HEADS entries of each of its local lists, a small part of the
   table. The k-th best total of those is a lower bound of the k-th best score.
2. The bound over LISTS is a safe cutoff: whoever is below it in every list has a smaller total.
   It goes to all blocks with the query. They read each list down to where the lengths can no
   longer reach the cutoff, and collect the entries whose score in the list does.
3. Entries that could not reach the bound even with the cutoff (or the lengths' product, if that
   is less) in the lists that did not report them are dropped. For the others, and for them
   alone, the missing components are fetched, and the exact totals are ranked.

So each list is scored once, apart from its head. Queries and candidates are dealt to a grid of
blocks; each pair of blocks is one group of two bounded matrices, so no task grows with the input.
Equal vectors are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .vectors import answers, block, classes, is_query, matrix, query_classes, same_width, usable

LISTS = 2
QUERIES, CANDIDATES, STEP = 8192, 8192, 128  # block sizes, and queries at a time
HEADS = 256  # entries of each local list that the gather phase reads


def quantized(df: DataFrame, scale: int, vec_id: str, vec: str) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); rows without a usable vector go."""
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vec)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


def kind_for(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which all sums of products are exact."""
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    most = top[0] * top[1] * max(1, a.shape[1])
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def to_long(x: int) -> int:
    """The nearest value that a long holds."""
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def pair(q: pa.Table, c: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    a, b = same_width(matrix(q, "v", np.int64), matrix(c, "v", np.int64))
    kind = kind_for(a, b)
    return a.astype(kind), b.astype(kind)


def slices(d: int) -> list[slice]:
    cuts = np.linspace(0, d, LISTS + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, a little too large rather than too small."""
    return np.sqrt((x.astype(float) ** 2).sum(1)) * (1 + 1e-9)


def gathered(a: np.ndarray, b: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of a the k largest totals with rows of b."""
    for i in range(0, len(a), STEP):
        total = a[i : i + STEP] @ b.T
        if total.shape[1] > k:
            total = np.take_along_axis(total, np.argpartition(total.astype(float), total.shape[1] - k, axis=1)[:, -k:], 1)
        yield from total


@dataclass
class Read:
    """How much a block read: entries scored in lists, entries collected, components fetched."""

    scored: int = 0
    collected: int = 0
    fetched: int = 0


class Lists:
    """A block of candidates as LISTS lists."""

    def __init__(self, b: np.ndarray):
        self.b, self.slices = b, slices(b.shape[1])
        self.size = [lengths(b[:, s]) for s in self.slices]
        self.order = [np.argsort(-x, kind="stable") for x in self.size]
        self.sorted = [np.ascontiguousarray(b[o, s]) for o, s in zip(self.order, self.slices)]

    def depth(self, x: int, cut: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How far list x must be read for queries of a slice length and a cutoff."""
        least = np.where(cut > 0, cut / np.maximum(size, 1e-300), -1.0)
        return np.searchsorted(-self.size[x][self.order[x]], -least, side="right")

    def resolve(self, a: np.ndarray, low: np.ndarray, read: Read) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of a, candidate, exact total) of all whose total is low or more."""
        size = [lengths(a[:, s]) for s in self.slices]
        cut = low / LISTS
        cut = np.where(np.isfinite(cut), cut - np.abs(cut) * 1e-12, -np.inf)
        depth = [self.depth(x, cut, size[x]) for x in range(LISTS)]
        queue = np.argsort(sum(depth), kind="stable")  # alike ones are read together
        n = len(self.b)
        for i in range(0, len(a), STEP):
            at = queue[i : i + STEP]
            keys, values = [], []
            for x, s in enumerate(self.slices):
                d = int(depth[x][at].max())
                score = a[at][:, s] @ self.sorted[x][:d].T
                read.scored += score.size
                row, pos = np.nonzero(score >= cut[at][:, None])
                keys.append(row * n + self.order[x][pos])
                values.append(score[row, pos])
            every = np.unique(np.concatenate(keys))
            total, seen = np.zeros(len(every), self.b.dtype), np.zeros((LISTS, len(every)), bool)
            for x in range(LISTS):
                j = np.searchsorted(every, keys[x])
                total[j] += values[x]
                seen[x, j] = True
            row, cand = at[every // n], every % n
            most = total.astype(float)
            for x in range(LISTS):
                most += np.where(seen[x], 0.0, np.minimum(cut[row], size[x][row] * self.size[x][cand]))
            read.collected += len(every)
            stay = np.flatnonzero(most >= low[row] - np.abs(low[row]) * 1e-9)
            row, cand, total, seen = row[stay], cand[stay], total[stay], seen[:, stay]
            for x, s in enumerate(self.slices):
                j = np.flatnonzero(~seen[x])
                for part in np.array_split(j, len(j) // 65_536 + 1):
                    total[part] += (a[row[part], s] * self.b[cand[part], s]).sum(1)
                read.fetched += len(j) * (s.stop - s.start)
            yield row, cand, total


def best(row: np.ndarray, total: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: largest total, then smallest id."""
    order = np.lexsort((least, ~total, row))
    begin = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
    return order[rank < k]


def longs(x: np.ndarray) -> np.ndarray:
    return np.array([to_long(v) for v in x], np.int64) if x.dtype == object else x.astype(np.int64)


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query (vec_id divisible by every).

    The score is the inner product of floor(scale * x) components; ties go to the smaller vec_id.
    Rows whose vec_id is null or whose vector is null or holds a null or non-finite component
    take no part. A repeated row counts once; of a vec_id with several vectors none answers the
    id's own query. Vectors of different length compare as if filled up with zeros. A score that
    no long can hold is cut to the nearest. Fewer candidates give fewer rows, an empty table none.
    Other columns of df are left out."""
    rows = stored(quantized(df, scale, vec_id, vec), "rows")
    all_ = classes(rows, k)
    query_rows = rows.where(is_query(F.col("vec_id"), every))
    queries = stored(query_classes(query_rows), "queries")
    found = stored(all_, "classes")
    n_c, n_q = -(-found.count() // CANDIDATES), -(-queries.count() // QUERIES)
    width = found.agg(F.max(F.size("v")).alias("d")).first().d or 0
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    cands = found.withColumn("cb", block("v", n_c))

    # the heads: HEADS entries of each list of each block, so one in CANDIDATES / HEADS / LISTS
    heads = None
    for s in slices(width):
        size = F.aggregate(F.slice("v", s.start + 1, max(1, s.stop - s.start)), F.lit(0.0), lambda t, x: t + x.cast("double") * x)
        own = cands.withColumn("r", F.row_number().over(Window.partitionBy("cb").orderBy(size.desc(), "least"))).where(F.col("r") <= HEADS).select("v", "cb")
        heads = own if heads is None else heads.union(own)
    per_group = max(1, CANDIDATES // (LISTS * HEADS))
    heads = heads.distinct().select("v", F.floor(F.col("cb") / per_group).cast("int").alias("cb"))
    n_h = -(-n_c // per_group)

    def gather(q: pa.Table, c: pa.Table) -> pa.Table:
        names, totals = [], []
        if len(q) and len(c):
            a, b = pair(q, c)
            for name, total in zip(q.column("q").to_pylist(), gathered(a, b, k + 1)):
                names += [name] * len(total)
                totals += longs(total).tolist()
        return pa.table({"q": pa.array(names, pa.string()), "total": pa.array(totals, pa.int64())})

    def resolve(q: pa.Table, c: pa.Table) -> pa.Table:
        rows_, cands_, totals = [], [], []
        if len(q) and len(c):
            a, b = pair(q, c)
            least = c.column("least").to_numpy()
            low = np.array([-np.inf if x is None else x for x in q.column("bound").to_pylist()], float)
            for row, cand, total in Lists(b).resolve(a, low, Read()):
                total = longs(total)
                take = best(row, total, least[cand], k + 1)
                rows_.append(row[take])
                cands_.append(cand[take])
                totals.append(total[take])
        at, chosen, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows_, cands_, totals))
        empty = [pa.array([], pa.string()), pa.array([], pa.list_(pa.int64()))]
        names, ids = [q.column("q").take(pa.array(at)), c.column("ids").take(pa.array(chosen))] if len(at) else empty
        return pa.table([names, pa.array(score, pa.int64()), ids], names=["q", "score", "ids"])

    def over(asked: DataFrame, given: DataFrame, n: int, f, spec: str) -> DataFrame:
        left = asked.withColumns({"qb": block("q", n_q), "cb": grid(n)})
        right = given.withColumn("qb", grid(n_q))
        return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(f, spec)

    order = Window.partitionBy("q").orderBy(F.desc("total"))
    ranked = over(queries, heads, n_h, gather, "q string, total long").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    bounds = ranked.groupBy("q").agg(F.max(F.when(F.col("r") == k + 1, F.col("total"))).alias("bound"))
    asked = stored(queries.join(bounds, "q", "left"), "bounds")
    return answers(over(asked, cands, n_c, resolve, "q string, score long, ids array<long>"), query_rows, k)


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """top_k of the whole embeddings table; nulls, odd vectors, ties, repeated rows and empty
    tables as stated there."""
    return top_k(table(spark, sf_dir, "embeddings"))
