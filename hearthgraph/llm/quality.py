"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are pairs of neighbouring character classes, hashed byte trigrams, and how often
words repeat the word before or any earlier word. On a bounded sample of labelled rows (SAMPLE of
each label) the terms are weighted by inverse document frequency and reduced by a singular value
decomposition. The sample's vectors, at most 2 * SAMPLE rows of DIMS floats, are broadcast; every
document's cosine with each of them is computed exactly, in blocks, and the labels of the NEAR
nearest vote with their similarity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DoubleType

from .common import fold, table

SAMPLE = 1024  # labelled texts of each label that the model is fitted on, at most
DIMS = 48
NEAR = 15
SHAPES, GRAMS, EXTRA = 32, 2048, 16
TERMS = SHAPES * SHAPES + GRAMS + EXTRA
SLICE = 1 << 20  # bytes looked at at once


def _shape_table() -> np.ndarray:
    """A class for each byte: letters by case, digits, white space, signs of their own, the rest."""
    out = np.full(256, 30, np.uint16)
    out[128:] = 31
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c")):
        out[list(chars)] = k
    for k, c in enumerate(b".,;:!?'\"-_()[]{}<>/|\\@#$%", 5):
        out[c] = k
    return out


SHAPE = _shape_table()


def terms(text: str | None) -> np.ndarray:
    """Counts of the terms of a whole text; null is empty."""
    raw = (text or "").encode()
    out = np.zeros(TERMS, np.float64)
    for at in range(0, len(raw), SLICE):
        b = np.frombuffer(raw[at : at + SLICE + 2], np.uint8)  # the last two begin the next slice
        s = SHAPE[b]
        out[: SHAPES * SHAPES] += np.bincount(s[: SLICE + 1][:-1] * SHAPES + s[1 : SLICE + 1], minlength=SHAPES * SHAPES)
        if len(b) > 2:
            w = b.astype(np.uint32)
            h = (w[:-2] * np.uint32(7919) ^ w[1:-1] * np.uint32(104729) ^ w[2:] * np.uint32(1299709)) % np.uint32(GRAMS)
            out[SHAPES * SHAPES : SHAPES * SHAPES + GRAMS] += np.bincount(h, minlength=GRAMS)
    words = raw.split()
    if len(words) > 1:
        again = sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)
        fresh = len(set(words)) / len(words)
        # shares become terms of their own, as often as the text has characters
        bins = [min(7, int(again * 16)), 8 + min(7, int(fresh * 8))]
        out[SHAPES * SHAPES + GRAMS :][bins] = len(raw) / 4
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Voters:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        y = weighted(counts, self.idf) @ self.axes
        return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, texts: list[str | None], rows: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; one half without any."""
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        k = min(NEAR, len(self.labels))
        for i in range(0, len(texts), rows):
            x = self.latent(np.stack([terms(t) for t in texts[i : i + rows]]))
            cos = x @ self.vectors.T
            near = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cos, near, 1).astype(float), 0) ** 4
            vote = (w * self.labels[near]).sum(1)
            total = w.sum(1)
            out[i : i + rows] = np.where(total > 0, vote / np.maximum(total, 1e-300), self.labels.mean())
        return np.clip(out, 0, 1)


def fit_voters(counts: np.ndarray, labels: np.ndarray) -> Voters:
    n = len(labels)
    if not n:
        return Voters(np.ones(TERMS), np.zeros((TERMS, DIMS)), np.zeros((0, DIMS), np.float32), labels)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))) + 0.3
    x = weighted(counts, idf)
    # the leading right singular vectors, by subspace iteration from a fixed start
    basis = np.linalg.qr(x.T @ np.random.RandomState(0).randn(n, min(DIMS + 16, n)))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, size, right = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ right.T)[:, : min(DIMS, int((size > 1e-6).sum()))]
    made = Voters(idf, axes, np.zeros((0, 0), np.float32), labels)
    made.vectors = made.latent(counts)
    return made


@pandas_udf(BinaryType())
def _packed_terms(s: pd.Series) -> pd.Series:
    return pd.Series([zlib.compress(terms(t).astype("<f4").tobytes(), 1) for t in s])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: tuple[int, int]) -> DataFrame:
    """y, h, text: up to most[y] different texts of each label y, outside held_out (over doc_id).

    The texts of smallest hash h are taken, copies once, so a group of copies has one voice. Rows
    with null id, text or label are not learned from; of ids with both labels, neither."""
    marks = labels.where(F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z"))
    marks = marks.where((F.col("y") == F.col("z")) & F.col("y").isin(0, 1)).select("doc_id", F.col("y").cast("int").alias("y"))
    hashed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    heads = hashed.select("doc_id", "h").join(marks, "doc_id").select("y", "h").distinct()
    # two top lists of hashes; only their texts are looked at again
    chosen = [(r.y, r.h) for y in (0, 1) for r in heads.where(F.col("y") == y).orderBy("h").limit(most[y]).collect()]
    chosen = docs.sparkSession.createDataFrame(chosen, "y int, h long")  # at most sum(most) rows
    return hashed.join(F.broadcast(chosen), "h").groupBy("y", "h").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: Column) -> Voters:
    """Fit on up to SAMPLE different texts of each label, outside held_out (over doc_id)."""
    picked = labelled_sample(docs, labels, label, held_out, (SAMPLE, SAMPLE))
    rows = picked.select("y", "h", _packed_terms("text").alias("x")).toPandas().sort_values(["h", "y"])
    counts = np.stack([np.frombuffer(zlib.decompress(x), "<f4") for x in rows.x]).astype(float) if len(rows) else np.zeros((0, TERMS))
    return fit_voters(counts, rows.y.to_numpy(float))


def score_column(voters: Voters, text: Column) -> Column:
    """voters hold at most 2 * SAMPLE vectors and are sent to each executor once."""
    shared = SparkSession.active().sparkContext.broadcast(voters)

    @pandas_udf(DoubleType())
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(s.tolist()))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on).

    Every row is kept as it is; columns named score or predicted are replaced. Null and empty
    texts have no similarity to any voter and get the voters' share of label 1; without labelled
    rows every score is one half."""
    voters = train(docs, labels, label, held_out)
    return docs.withColumn("score", score_column(voters, F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """scored for the whole documents table; rows of null id are not held out. Nulls, empty texts,
    repeated rows and empty tables as stated there."""
    held_out = fold(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, table(spark, sf_dir, "labels"), held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
