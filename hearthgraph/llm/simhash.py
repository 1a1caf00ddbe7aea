"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

The index has its first level spread over the cluster: fingerprints that share a masked bit
pattern meet in one node. Two that differ in at most two bits agree on at least one of three
blocks of bits, so three masks find every link. A node with more than WIDE fingerprints gets a
second level of masks over the other bits (eight blocks, any six of them), after which no node
can hold more than 4,096 different fingerprints (two blocks of six bits are left free), whatever
the data.

Inside a node the fingerprints are sorted by Gray rank, which puts close ones side by side.
Sixteen neighbours at a time get an upper node with the bits that all of them share; nodes over
nodes do the same. Two nodes are compared on the bits shared on both sides; what they differ by
is carried down to their children, which add only the bits that are new there, and a pair whose
sum passes two is dropped with everything below it.

Equal fingerprints are one row of the index, so a group of copies of any size costs one entry;
links are given as edges to the smallest fingerprint they reach inside the node, so there are
never more edges than entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import stored, table, unused
from .components import components

NEAR = 2  # differing bits of a link
FANOUT = 16
WIDE = 2048
BLOCKS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: str | None, step: int = 1 << 16) -> int:
    """64 bits: a bit is set if it is set in over half of the hashes of the 3-word shingles.

    Fewer than three words: one shingle of them all; no word (or null): zero."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    count, n = np.zeros(64, np.int64), max(1, len(words) - 2)
    for k in range(0, n, step):
        w = words[k : k + step + 2]
        shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(words) >= 3 else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def near_pairs(fps: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j in Gray order) of different fingerprints that differ in few bits."""
    levels = []
    low = high = fps  # bits set in all, bits set in any
    while True:
        levels.append((~(low ^ high), low))
        if len(low) <= FANOUT:
            break
        cuts = np.arange(0, len(low), FANOUT)
        low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
    i, j = np.triu_indices(len(low))
    shared = np.zeros(len(i), np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(len(levels) - 1, i, j, shared, np.zeros(len(i), np.int64))]
    while todo:
        level, i, j, above, diff = todo.pop()
        mask, value = levels[level]
        both = mask[i] & mask[j]
        diff = diff + np.bitwise_count((value[i] ^ value[j]) & both & ~above)
        keep = diff <= near
        i, j, both, diff = i[keep], j[keep], both[keep], diff[keep]
        if level == 0:
            keep = i < j
            found.append((i[keep], j[keep]))
            continue
        n = len(levels[level - 1][0])
        for k in range(0, len(i), 1 << 12):  # bounds memory
            s = slice(k, k + (1 << 12))
            a = np.repeat(i[s, None] * FANOUT + np.arange(FANOUT), FANOUT, 1).ravel()
            b = np.tile(j[s, None] * FANOUT + np.arange(FANOUT), FANOUT).ravel()
            ok = (a <= b) & (b < n) & (a < n)
            todo.append((level - 1, a[ok], b[ok], np.repeat(both[s], FANOUT**2)[ok], np.repeat(diff[s], FANOUT**2)[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach over pairs a, b."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _node_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, fp) sorted by node -> an edge from each linked fp to the smallest it reaches."""
    held_n, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), node))
        node, fp = node[order], fp[order]
        begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, int)
        size = np.diff(np.r_[begin, len(node)])
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        one_leaf = np.repeat(size <= FANOUT, size)  # nodes of one leaf: compared side by side
        for d in range(1, FANOUT):
            i = np.flatnonzero(one_leaf[:-d] & (node[:-d] == node[d:])) if len(node) > d else a[0]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= NEAR]
            a.append(i)
            b.append(i + d)
        for at, n in zip(begin[size > FANOUT].tolist(), size[size > FANOUT].tolist()):
            i, j = near_pairs(fp[at : at + n])
            a.append(i + at)
            b.append(j + at)
        root = smallest(len(fp), np.concatenate(a), np.concatenate(b))
        k = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[k].view(np.int64)), pa.array(fp[root[k]].view(np.int64))], ["a", "b"])

    for batch in batches:
        held_n = np.concatenate([held_n, batch.column(0).to_numpy()])
        held_f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(held_n, held_n[-1])) if len(held_n) and (np.diff(held_n) >= 0).all() else 0
        if cut:
            yield links(held_n[:cut], held_f[:cut])
            held_n, held_f = held_n[cut:], held_f[cut:]
    yield links(held_n, held_f)


def _masked(fp, block: int):
    lo, hi = BLOCKS[block]
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _rest(fp, block: int):
    """The bits outside the block, moved together."""
    lo, hi = BLOCKS[block]
    below = fp.bitwiseAND(F.lit((1 << lo) - 1))
    return below if hi == 64 else F.shiftleft(F.shiftrightunsigned(fp, hi), lo).bitwiseOR(below)


def links(fps: DataFrame) -> DataFrame:
    """fps (one row for each different fp) -> edges (a, b) that link what is near."""
    fp = F.col("fp")
    first = fps.select("fp", F.posexplode(F.array(*[_masked(fp, k) for k in range(3)])).alias("block", "bits"))
    first = first.withColumn("node", F.col("bits") * 4 + F.col("block"))
    # counted with partial sums, so a full node costs no more than any other
    sizes = first.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    first = stored(first.join(sizes, "node").select("node", "fp", "block", "n"), "nodes")
    wide = first.where(F.col("n") > WIDE)
    rest = F.when(F.col("block") == 0, _rest(fp, 0)).when(F.col("block") == 1, _rest(fp, 1)).otherwise(_rest(fp, 2))
    subs = []
    for k, left_out in enumerate(combinations(range(8), 2)):
        mask = sum(((1 << min(6, 43 - 6 * b)) - 1) << (6 * b) for b in range(8) if b not in left_out)
        subs.append(F.xxhash64("node", F.lit(k), F.col("rest").bitwiseAND(F.lit(mask))))
    second = wide.withColumn("rest", rest).select(F.explode(F.array(*subs)).alias("node"), "fp")
    dealt = first.where(F.col("n") <= WIDE).select("node", "fp").union(second)
    # a hash that two second-level nodes share only compares more pairs than it must
    return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_node_links, "a long, b long")


@pandas_udf(LongType())
def fingerprint_udf(s: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of df.

    component_id is the smallest doc_id that links reach, its own included. Null and empty texts
    have fingerprint zero and link like any other. A null doc_id takes part in links and never is
    a component_id unless (as null) all of its component are null. Repeated rows stay repeated.
    Other columns of df are left out."""
    rows = stored(df.select(F.col(doc_id).alias("doc_id"), fingerprint_udf(F.col(text)).alias("fp")), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    rooted = stored(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component of docs the one row that is smallest by doc_id (null last), then by the
    hash of its text.

    All columns of docs stay. Components are of rows, so different texts under one doc_id, or
    under none, stand each for its own component."""
    (row,) = unused(docs, "_row")
    text = F.col("text").cast("binary")
    named = F.when(F.col("doc_id").isNull(), "?").otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string")))
    # one key for id and text, never null: the join and the last step share one shuffle
    docs_ = docs.withColumn(row, F.md5(F.concat(named.cast("binary"), F.lit("|").cast("binary"), F.coalesce(F.md5(text), F.lit("")).cast("binary"))))
    rows = docs_.select("doc_id", F.md5(text).alias("h"), F.col(row).alias("row"), fingerprint_udf(F.col("text")).alias("fp"))
    fps = stored(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "row")).alias("least")), "distinct")
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "least")
    best = rooted.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.row").alias(row))
    return docs_.join(best, row, "left_semi").dropDuplicates([row]).select(docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """near_duplicates of the whole documents table; nulls, empty texts, repeated rows and empty
    tables as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
