"""Approximate nearest neighbours by learned partitions.

On a bounded sample (SAMPLE different vectors) the graph of nearest neighbours is built and cut
into parts of equal size with few edges between them. A softmax classifier learns, for a vector,
how its neighbours spread over the parts. It then deals every row of the table to its most
probable part, and routes a query to as many parts as held-out sample queries needed to find
RECALL of their neighbours.

Parts that would hold more than PART vectors are cut once more in the same way, each on a bounded
sample of its own rows and in a task of its own, so that leaves keep their size as the table grows
(256 parts of up to 256 leaves). What the leaves hold is reranked by the exact measure. A query
costs as many products as the leaves it probes hold: probes of parts, times probes inside a part,
times PART.

Rows and queries of a leaf are dealt to blocks of bounded size, so a large leaf is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from .common import stored, table
from .vectors import answers, classes, is_query, matrix, query_classes, same_width, usable

SAMPLE = 8192  # vectors that the index is fitted on, whatever the table's size
DEGREE = 16  # neighbours of a vector in the graph
RECALL, INNER_RECALL = 0.95, 0.98  # share of held-out neighbours that the probed parts, and in a part the probed leaves, must hold
PART, MOST_PARTS = 4096, 256  # vectors that a part or leaf is meant to hold; parts, and leaves of a part, at most
QUERIES, CANDIDATES, STEP = 8192, 8192, 128


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest others (largest inner product) of the rows `of`, all by default."""
    of = np.arange(len(x)) if of is None else of
    k = min(k, len(x) - 1)
    out = np.zeros((len(of), k), int)
    for i in range(0, len(of), 512):
        s = x[of[i : i + 512]] @ x.T
        s[np.arange(len(s)), of[i : i + 512]] = -np.inf
        out[i : i + 512] = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:]
    return out


def halves(x: np.ndarray, parts: int) -> np.ndarray:
    """A first balanced cut: medians along the directions of largest spread, again and again."""
    label = np.zeros(len(x), int)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        new = []
        for g in groups:
            y = x[g] - x[g].mean(0)
            order = g[np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")]
            new += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = new
    for i, g in enumerate(groups):
        label[g] = i
    return label


def refine(label: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 25) -> np.ndarray:
    """Swap equal numbers of vertices between two parts while that cuts fewer edges."""
    n, k = graph.shape
    label = label.copy()
    source, target = np.repeat(np.arange(n), k), graph.ravel()
    for r in range(rounds):
        near = np.zeros((n, parts))
        np.add.at(near, (source, label[target]), 1)
        np.add.at(near, (target, label[source]), 1)
        gain = near - near[np.arange(n), label][:, None]
        gain[np.arange(n), label] = -np.inf
        want = gain.argmax(1)
        best = gain[np.arange(n), want]
        moved = 0
        for a in range(parts):
            for b in range(a + 1, parts):
                there = np.flatnonzero((label == a) & (want == b))
                back = np.flatnonzero((label == b) & (want == a))
                there, back = there[np.argsort(-best[there], kind="stable")], back[np.argsort(-best[back], kind="stable")]
                m = min(len(there), len(back))
                m = int(np.sum(best[there[:m]] + best[back[:m]] > 0)) // (1 + r % 2)  # half at odd rounds: no swinging
                label[there[:m]], label[back[:m]] = b, a
                moved += m
        if not moved:
            break
    return label


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(x: np.ndarray, want: np.ndarray, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Weights (with a last row of biases) of a softmax fit to the distributions `want`."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v = (np.zeros((x.shape[1], want.shape[1])) for _ in range(3))
    for t in range(1, steps + 1):
        g = x.T @ (softmax(x @ w) - want) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Level:
    """One router: to which of its parts a vector and its neighbours probably belong."""

    weights: np.ndarray
    scale: float
    probes: int

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first."""
        d = len(self.weights) - 1
        x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
        return np.argsort(-(x / self.scale @ self.weights[:-1] + self.weights[-1]), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int, k: int = 20, recall: float = RECALL) -> Level:
    if parts < 2:
        return Level(np.zeros((x.shape[1] + 1, 1)), 1.0, 1)
    scale = float(np.sqrt((x**2).sum(1).mean())) or 1.0
    y = x / scale
    graph = neighbours(y, DEGREE)
    label = refine(halves(y, parts), graph, parts)
    want = np.zeros((len(y), parts))
    np.add.at(want, (np.repeat(np.arange(len(y)), graph.shape[1]), label[graph].ravel()), 1)
    held = np.arange(len(y)) % 8 == 0  # a part of the sample sets the number of probes
    want[np.arange(len(y)), label] += 1
    level = Level(learn(y[~held] * np.sqrt(y.shape[1]), (want / want.sum(1, keepdims=True))[~held]), scale / np.sqrt(y.shape[1]), parts)
    ranked = level.ranked(x)
    true = neighbours(y, k, np.flatnonzero(held))
    place = np.argsort(ranked[held], axis=1)  # rank of each part for each held-out query
    found = place[np.arange(len(true))[:, None], ranked[true, 0]]
    share = [(found < p).mean() for p in range(1, parts + 1)]
    level.probes = next((p for p, s in enumerate(share, 1) if s >= recall), parts)
    return level


def parts_for(n: int, least: int) -> int:
    """Parts of about PART vectors: a power of two from `least` to MOST_PARTS, four vectors in
    each at the fewest."""
    wanted = min(MOST_PARTS, max(least, n // PART))
    return 1 << max(0, int(np.log2(max(1, min(wanted, n // 4)))))


@dataclass
class Index:
    """Parts, and the leaves of each; leaf number = part * most + leaf of the part."""

    top: Level
    inner: dict[int, Level]
    most: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf that holds each row."""
        part = self.top.ranked(x)[:, 0]
        out = part * self.most
        for p in np.unique(part):
            if p in self.inner:
                out[part == p] += self.inner[p].ranked(x[part == p])[:, 0]
        return out

    def routes(self, x: np.ndarray, sizes: dict[int, int], least: int) -> list[list[int]]:
        """The leaves that each row probes: the most probable of its most probable parts, and as
        many of those after them as it takes to see `least` vectors, or all."""
        ranked = self.top.ranked(x)
        inside = {p: level.ranked(x) for p, level in self.inner.items()}
        out = []
        for i, parts in enumerate(ranked.tolist()):
            near, far = [], []
            for r, p in enumerate(parts):
                own = [p * self.most + int(j) for j in (inside[p][i] if p in inside else [0])]
                n = self.inner[p].probes if p in inside else 1
                (near if r < self.top.probes else far).extend(own[:n])
                far += own[n:]
            near = [x for x in near if x in sizes]
            seen = sum(sizes[x] for x in near)
            for leaf in far:
                if seen >= least:
                    break
                if leaf in sizes:
                    near.append(leaf)
                    seen += sizes[leaf]
            out.append(near)
        return out


def sequential(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    s = np.zeros(len(a))
    for d in range(a.shape[1]):
        s += a[:, d] * b[:, d]
    return s


def fit_top(all_: DataFrame, n: int, k: int) -> Level:
    """Fit on the SAMPLE different vectors of smallest hash."""
    got = all_.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
    return fit(matrix(got, "v", np.float64), parts_for(n, 16), k)


def fit_inner(parts: DataFrame, sizes: dict[int, int], k: int) -> dict[int, Level]:
    """A router for each part of more than PART vectors, fitted where the part's sample is.

    What comes back is bounded: MOST_PARTS routers of MOST_PARTS columns."""
    large = {p: parts_for(n, 1) for p, n in sizes.items() if parts_for(n, 1) > 1}
    if not large:
        return {}
    order = Window.partitionBy("part").orderBy("h", "v")
    own = parts.where(F.col("part").isin(list(large))).select("part", "v", F.xxhash64("v").alias("h"))
    sample = own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).select("part", "v")

    def one(t: pa.Table) -> pa.Table:
        p = t.column("part")[0].as_py()
        x = matrix(t, "v", np.float64)
        level = fit(x, min(large[p], 1 << (max(4, len(x)).bit_length() - 3)), k, INNER_RECALL)
        return pa.table([[p], [level.scale], [level.probes], [level.parts], [level.weights.astype("<f8").tobytes()]], names=["part", "scale", "probes", "parts", "weights"])

    found = sample.groupBy("part").applyInArrow(one, "part long, scale double, probes long, parts long, weights binary").collect()
    return {r.part: Level(np.frombuffer(r.weights, "<f8").reshape(-1, r.parts), r.scale, r.probes) for r in found}


def spark_rows(df: DataFrame, spec: str) -> DataFrame:
    """No rows of these columns."""
    return df.sparkSession.createDataFrame([], spec)


def nearest(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest of each query (vec_id divisible by
    every), by inner product in double precision, ties to the smaller vec_id.

    Rows whose vec_id is null or whose vector is null, zero or holds a null or non-finite
    component take no part. A repeated row counts once; of a vec_id with several vectors none
    answers the id's own query. Vectors of different length compare as if filled up with zeros.
    A query whose probed leaves hold fewer than k others probes further ones until it has seen k, or
    all. An empty table gives no rows.
    Other columns of df are left out."""
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vec)) & F.exists(vec, lambda x: x != 0))
    rows = stored(rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vec, lambda x: x.cast("double") + 0.0).alias("v")).distinct(), "rows")
    all_ = stored(classes(rows, k), "classes")
    query_rows = rows.where(is_query(F.col("vec_id"), every))
    queries = stored(query_classes(query_rows), "queries")
    total = all_.count()
    if not total:
        return answers(spark_rows(df, "q string, score double, ids array<long>"), query_rows, k)
    top = fit_top(all_, total, k)

    def wide(v: pd.Series) -> np.ndarray:
        d = max(map(len, v))
        return np.stack([x if len(x) == d else np.pad(x, (0, d - len(x))) for x in v])

    @pandas_udf(IntegerType())
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(top.ranked(wide(v))[:, 0].astype(np.int32) if len(v) else [], dtype="int32")

    parts = stored(all_.withColumn("part", part_of("v")), "parts")
    counted = lambda d, c: {r[0]: r.n for r in d.groupBy(c).agg(F.count("*").alias("n")).collect()}
    index = Index(top, fit_inner(parts, counted(parts, "part"), k), MOST_PARTS)  # a size for each of at most MOST_PARTS parts

    @pandas_udf(IntegerType())
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(index.leaf(wide(v)).astype(np.int32) if len(v) else [], dtype="int32")

    leaves = stored(parts.withColumn("leaf", leaf_of("v")), "leaves")
    sizes = counted(leaves, "leaf")  # at most MOST_PARTS * MOST_PARTS rows

    @pandas_udf(ArrayType(IntegerType()))
    def routed(v: pd.Series) -> pd.Series:
        return pd.Series(index.routes(wide(v), sizes, k + 1) if len(v) else [], dtype="object")

    asked = stored(queries.withColumn("leaf", F.explode(routed("v"))), "routed")
    asking = counted(asked, "leaf")
    blocks = lambda n, size: max(1, -(-n // size))
    # a row for each leaf: how many blocks its rows and its queries are dealt to
    deal = df.sparkSession.createDataFrame([(x, blocks(n, CANDIDATES), blocks(asking[x], QUERIES)) for x, n in sizes.items() if x in asking], "leaf int, n_c int, n_q int")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cands = leaves.join(F.broadcast(deal), "leaf").withColumns({"cb": F.pmod(F.xxhash64("least"), F.col("n_c")).cast("int"), "qb": grid("n_q")}).select("leaf", "qb", "cb", "v", "least", "ids")
    asked = asked.join(F.broadcast(deal), "leaf").withColumns({"qb": F.pmod(F.xxhash64("q"), F.col("n_q")).cast("int"), "cb": grid("n_c")}).select("leaf", "qb", "cb", "v", "q")

    def rerank(q: pa.Table, c: pa.Table) -> pa.Table:
        names, score, chosen = [], [], []
        if len(q) and len(c):
            a, b = same_width(matrix(q, "v", np.float64), matrix(c, "v", np.float64))
            ids, least = q.column("q").to_pylist(), c.column("least").to_numpy()
            take = min(k + 9, len(b))  # sums in another order differ in the last places
            for i in range(0, len(a), STEP):
                near = np.argpartition(s := a[i : i + STEP] @ b.T, s.shape[1] - take, axis=1)
                edge = np.take_along_axis(s, near[:, -take:-take + 1] if take > 1 else near[:, -1:], 1)
                for r in range(len(s)):
                    own = near[r, -take:]
                    if take < len(b):  # all that tie with the last one
                        own = np.flatnonzero(s[r] >= edge[r, 0] - 1e-12 * abs(edge[r, 0]))
                    exact = sequential(np.broadcast_to(a[i + r], (len(own), a.shape[1])), b[own])
                    order = np.lexsort((least[own], -exact))[: k + 1]
                    names += [ids[i + r]] * len(order)
                    score += exact[order].tolist()
                    chosen += own[order].tolist()
        ids_ = c.column("ids").take(pa.array(chosen, pa.int64())).combine_chunks() if chosen else pa.array([], pa.list_(pa.int64()))
        return pa.table([pa.array(names, pa.string()), pa.array(score, pa.float64()), ids_], names=["q", "score", "ids"])

    key = ("leaf", "qb", "cb")
    found = asked.groupBy(*key).cogroup(cands.groupBy(*key)).applyInArrow(rerank, "q string, score double, ids array<long>")
    return answers(found, query_rows, k)


def op3_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """nearest for the whole embeddings table; nulls, odd vectors, ties, repeated rows and empty
    tables as stated there."""
    return nearest(table(spark, sf_dir, "embeddings"))
