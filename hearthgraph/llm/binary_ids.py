"""Token ids in a compact binary file format.

Ids are replaced by their rank of frequency in the whole corpus (most frequent first), so that
most take one byte. A file is any number of blocks, one after the other. A block is

    header   8 little-endian uint64: magic, documents, ids, start (ids of all documents before the
             block), bytes of names, of lengths, of control and of data
    names    the documents' ids, as an Arrow stream of one column
    lengths  documents x uint32, ids of each document, its end id included
    control  2 bits for each id, four to a byte, lowest bits first: bytes of that rank less one;
             each document begins a new control byte
    data     the ranks' bytes, little-endian, without gaps

Control and data bytes stand apart, so a block is decoded by table lookup: a control byte gives
the lengths of four ranks at once, and a running sum gives where each begins. The file of ranks
holds the id of each rank as uint32, in order. With it, the block files can be read on their own.

Texts are sorted by doc_id over the cluster, encoded in that order and kept as blocks of plain ids
until the frequencies are known; then each task writes its blocks to a new file in any store that
pyarrow can open, and gives an index row for each block. The index is written by Spark, so it names
only files of tasks that ended; what a lost task left is never looked at.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, scratch, table

MAGIC, HEADER = 0x32424956534449, "<8Q"
SIZE = struct.calcsize(HEADER)
BLOCK = 1 << 17  # ids in a block, unless one document has more
TASK = 32 << 20  # bytes of blocks that a reading task is meant to have
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The ranks of documents with so many ids each, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    slots = -(-lengths // 4) * 4
    used = np.ones(int(slots.sum()), bool)
    for k in (1, 2, 3):  # what a document leaves of its last control byte
        used[np.cumsum(slots)[slots - lengths >= k] - k] = False
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[used]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


def pack_block(names: pa.Array, start: int, lengths: np.ndarray, control: bytes, data: bytes) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", names.type)])) as out:
        out.write_batch(pa.record_batch([names], ["doc_id"]))
    own = sink.getvalue().to_pybytes()
    sizes = np.asarray(lengths, "<u4").tobytes()
    return struct.pack(HEADER, MAGIC, len(lengths), int(np.sum(lengths)), start, len(own), len(sizes), len(control), len(data)) + own + sizes + control + data


def unpack_block(block: bytes) -> tuple[pa.Array, int, np.ndarray, np.ndarray]:
    """doc_ids, start, lengths of the documents and all ranks."""
    if len(block) < SIZE:
        raise ValueError("not a block of ids")
    magic, docs, n, start, *sizes = struct.unpack_from(HEADER, block)
    if magic != MAGIC or len(block) != SIZE + sum(sizes) or sizes[1] != 4 * docs:
        raise ValueError("not a block of ids")
    cuts = np.cumsum([SIZE, *sizes]).tolist()
    own, raw, control, data = (block[a:b] for a, b in zip(cuts, cuts[1:]))
    lengths = np.frombuffer(raw, "<u4")
    ranks = decode_ranks(control, data, lengths)
    if len(ranks) != n:
        raise ValueError("not a block of ids")
    return pa.ipc.open_stream(own).read_all().column(0).combine_chunks(), start, lengths, ranks


def planes(ids: np.ndarray, width: int) -> bytes:
    """All lowest bytes, then all next ones: what is handed over compresses better so."""
    return np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return np.ascontiguousarray(x).view(f"<u{width}").ravel()


def ordered(df: DataFrame, path: str, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Blocks of plain ids of the sorted texts: part (task), block, start in the part, n, doc_ids,
    lengths, width and ids (as planes)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .chunk_ids import ids_of

        encoder, part = ids_of(path), TaskContext.get().partitionId()
        width = 2 if encoder.size <= 1 << 16 else 4
        names, held, size, block, start, type_ = [], [], 0, 0, 0, None

        def out() -> pa.RecordBatch:
            body = planes(np.concatenate(held), width)
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(type_)), pa.array([list(map(len, held))], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "block", "start", "n", "doc_ids", "lengths", "width", "ids"])

        for b in batches:
            type_ = b.schema.field(0).type
            for k in range(0, b.num_rows, 256):
                rows = b.slice(k, 256)
                for name, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    x = np.array([*encoder.encode(t or ""), end_id], "<u4")
                    if size and size + len(x) > BLOCK:
                        yield out()
                        start, block = start + size, block + 1
                        names, held, size = [], [], 0
                    names.append(name)
                    held.append(x)
                    size += len(x)
        if size:
            yield out()

    # rows of one id are dealt on by their texts
    order = [F.col("doc_id").asc_nulls_first(), F.length("text").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spec = f"part int, block long, start long, n long, doc_ids array<{kind}>, lengths array<long>, width int, ids binary"
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, spec)


def id_counts(blocks: DataFrame) -> DataFrame:
    """id and how often it occurs in all rows; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for width, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.bincount(from_planes(raw.as_buffer(), width))
                if len(x) > len(total):
                    total = np.concatenate([total, np.zeros(len(x) - len(total), np.int64)])
                total[: len(x)] += x
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return blocks.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def write_ids(df: DataFrame, path: str, out: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the texts' ids to files in out/blocks, their ranks to out/ranks, and out/index.

    Ascending doc_id (nulls first; rows of the same id by length and hash of the text), every row,
    null text as empty. An empty table gives an index without rows. Other columns are left out."""
    spark = df.sparkSession
    kept = scratch(spark, "plain-ids")
    ordered(df, path, end_id, doc_id, text).write.option("compression", "zstd").parquet(kept)
    blocks = spark.read.parquet(kept)
    # at most a row for each id of the vocabulary
    ranked = sorted((-r.n, r.id) for r in id_counts(blocks).toLocalIterator())
    order = np.array([i for _, i in ranked], "<u4")
    fs, root = place(out)
    fs.create_dir(f"{root}/blocks", recursive=True)
    with fs.open_output_stream(f"{root}/ranks") as f:
        f.write(order.tobytes())
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank_of)
    # a row for each part (task) of the sorting job: all that is summed in one place
    sizes = blocks.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, file, stream, at, store = shared.value, f"blocks/{uuid.uuid4().hex}", None, 0, place(out)
        rows = []
        for b in batches:
            for start, names, lengths, width, raw in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), b.column(4)):
                lengths = lengths.values.to_numpy()
                ends = np.cumsum(lengths)
                ranks = rank[from_planes(raw.as_buffer(), width)]
                coded = [encode_ranks(ranks[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                body = pack_block(names.values, start, lengths, b"".join(c for c, _ in coded), b"".join(d for _, d in coded))
                if stream is None:
                    stream = store[0].open_output_stream(f"{store[1]}/{file}")
                stream.write(body)
                rows.append((file, at, len(body), start, len(lengths), int(ends[-1])))
                at += len(body)
        if stream is not None:
            stream.close()
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["file", "at", "bytes", "start", "documents", "n"])

    # base has a row for each task of the sorting job, so its size does not follow the rows
    coded = blocks.join(F.broadcast(base), "part").select((F.col("start") + F.col("base")).alias("start"), "doc_ids", "lengths", "width", "ids")
    coded.mapInArrow(run, "file string, at long, bytes long, start long, documents long, n long").write.parquet(f"{out}/index")
    drop(spark, kept)


def read_ids(spark: SparkSession, out: str, kind: str = "bigint") -> DataFrame:
    """doc_id (of a type that kind names), start (ids of all documents before it), n_tokens and
    ids (uint32, little-endian), read from the block files."""
    index = spark.read.parquet(f"{out}/index")
    fs, root = place(out)
    with fs.open_input_stream(f"{root}/ranks") as f:  # at most an entry for each id of the vocabulary
        shared = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (store, at_) = shared.value, place(out)
        for b in batches:
            for file, at, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(f"{at_}/{file}") as f:
                    names, start, lengths, ranks = unpack_block(f.read_at(size, at))
                all_ids = ids[ranks].astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = [all_ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([names, pa.array(start + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    total = index.agg(F.sum("bytes").alias("n")).first().n or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK + 1)
    dealt = index.select("file", "at", "bytes").repartition(tasks, "file", "at")
    return dealt.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def digests(docs: DataFrame) -> DataFrame:
    """read_ids with ids_crc32 in place of the ids (crc32 of the bytes, native)."""
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_binary_ids(spark, sf_dir: str) -> DataFrame:
    """The whole documents table written by write_ids and read back from the files; nulls, empty
    texts, repeated rows and empty tables as stated there."""
    import public_tokenizers

    out, docs = scratch(spark, "token-ids"), table(spark, sf_dir, "documents")
    write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), out)
    return digests(read_ids(spark, out, docs.schema["doc_id"].dataType.simpleString()))
