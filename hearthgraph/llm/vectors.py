"""What the vector searches share: clean rows, classes of equal vectors, blocks, final ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def usable(vec: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))


def is_query(vec_id: Column, every: int) -> Column:
    return F.pmod(vec_id, F.lit(every)) == 0


def classes(rows: DataFrame, k: int) -> DataFrame:
    """rows (vec_id, v) -> v, least (smallest id) and ids (the k + 1 smallest), one row for each
    different vector. Ranks are cut in each task before the shuffle, so a vector that a third of
    the rows share costs k + 1 rows a task."""
    order = Window.partitionBy("v").orderBy("vec_id")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    return top.groupBy("v").agg(F.min("vec_id").alias("least"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def query_classes(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v) -> v and q (smallest query id of that vector)."""
    return rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.xxhash64("v").alias("h")).select("v", F.concat_ws(":", "id", "h").alias("q"))


def block(key: str, n: int) -> Column:
    """An int, as the numbers of the grid are: both sides of a cogroup must hash alike."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, n))).cast("int")


def matrix(t: pa.Table, name: str, kind: type) -> np.ndarray:
    """The rows of a list column; shorter vectors are filled up with zeros."""
    col = t.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    if len(size) and (size == size[0]).all():
        return flat[at[0] : at[-1]].reshape(len(size), size[0]).astype(kind)
    out = np.zeros((len(size), int(size.max(initial=0))), kind)
    for i, (a, n) in enumerate(zip(at[:-1].tolist(), size.tolist())):
        out[i, :n] = flat[a : a + n]
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    wide = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))
    return wide(a), wide(b)


def answers(found: DataFrame, query_rows: DataFrame, k: int) -> DataFrame:
    """found (q, score, ids): nearest classes of each query vector, from any number of blocks;
    query_rows (vec_id, v). Gives query_id, rank, vec_id, score: the k best rows of each query
    without its own, ties to smaller ids. Ranks are cut in each task before each shuffle."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = found.select("q", "score", F.explode("ids").alias("vec_id"))
    best = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = stored(best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best")), "best")
    named = query_rows.join(query_classes(query_rows), "v").select(F.col("vec_id").alias("query_id"), "q")
    own = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = named.join(lists, "q").select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
