"""Prefix trie of conversations with totals of every subtree, by depth-band rollup.

1. Turns are numbered by one range shuffle over (conversation, turn), so a conversation of any
   length lies in as many tasks as it needs; a row's number is its place in its task plus what the
   tasks before hold of its conversation.
2. A prefix is named by the exclusive or of hashes of (position, role and text), 128 bits wide, so
   prefixes are running values: inside bands of HEIGHT turns in arrays, over bands in windows of WIDE
   bands and of what those add up to. No conversation is collected.
3. A node is one group of equal prefixes: members, smallest member, parent.
4. Subtree totals: each node adds to its ancestors inside its band alone (HEIGHT at most). The tops
   of the bands are a trie of their own, HEIGHT times flatter, with the bands' totals as values; it is
   rolled up in the same way, and the finished totals of the tops go to the ancestors in the band
   above. So a trie of depth d takes log(d) / log(HEIGHT) rounds, and no node explodes to more than
   HEIGHT ancestors in a round.

Every sum is built up in the tasks before it is shuffled, so nodes that a third of all conversations
share cost a row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Turns of a band; bands of a window; ids of a piece of a list of ids; parents with more than one in
#: SHARE of all nodes as children are joined by broadcast (there are fewer than SHARE of them).
HEIGHT, WIDE, PIECE, SHARE = 16, 1024, 4096, 2048


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, o (place in the conversation, from 1), turns (of the conversation), e (digest of role
    and text) and bytes (of the text) of each turn with a conv_id. Null turns come first, equal ones
    by digest; null role and text are empty."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)).alias("e"), F.octet_length(said).cast("long").alias("bytes")
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("e"), F.col("s")]
    rows = rows.withColumn("s", F.monotonically_increasing_id())  # parts equal rows
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "s").withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows, "turns").withColumn("task", F.shiftright("at", 33))
    spans = rows.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "task", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(whole).alias("turns"))
    return rows.join(spans, ["conv_id", "task"]).select("conv_id", (F.col("at") + F.col("shift")).alias("o"), "turns", "e", "bytes")


def xor_of(t: Column, field: str, n: Column) -> Column:
    """Of the first n elements."""
    return F.aggregate(F.slice(t, 1, n), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[field]))


def paths(turns: DataFrame, height: int) -> DataFrame:
    """turns (conv_id, pos from 1, e, bytes, size) and a row with pos 0 and null e for each
    conversation -> a row for each of its bands: conv_id, band, keys (of the prefixes that end in the
    band), bytes (of their last texts), before (key of the prefix above), size."""
    x = lambda *c: F.when(F.col("pos") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*c))
    rows = turns.select("conv_id", F.expr(f"pos div {height}").alias("band"), "size", F.struct("pos", x(F.col("pos"), F.col("e")).alias("a"), x(F.col("e"), F.col("pos"), F.lit(1)).alias("b"), F.col("bytes")).alias("x"))
    bands = stored(rows.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("x")).alias("t"), F.max("size").alias("size")), "bands")
    every = F.size("t")
    sums = bands.where(F.col("size") >= height).select("conv_id", "band", F.expr(f"band div {WIDE}").alias("part"), xor_of(F.col("t"), "a", every).alias("a"), xor_of(F.col("t"), "b", every).alias("b"))
    so_far = lambda w: [F.coalesce(F.expr(f"bit_xor({c})").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(f"{c}_in") for c in "ab"]
    parts = sums.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).select("conv_id", "part", *so_far(Window.partitionBy("conv_id").orderBy("part")))
    inside = sums.select("conv_id", "band", "part", *so_far(Window.partitionBy("conv_id", "part").orderBy("band"))).withColumnsRenamed({"a_in": "a_own", "b_in": "b_own"})
    carry = inside.join(parts, ["conv_id", "part"]).select("conv_id", "band", *[F.col(f"{c}_in").bitwiseXOR(F.col(f"{c}_own")).alias(f"{c}0") for c in "ab"])
    zero = F.lit(0).cast("long")
    found = bands.join(carry, ["conv_id", "band"], "left").withColumns({c: F.coalesce(c, zero) for c in ("a0", "b0")})
    keys = F.transform(F.sequence(F.lit(1), every), lambda i: F.struct(*[xor_of(F.col("t"), c, i).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "ab"]))
    return stored(found.select("conv_id", "band", keys.alias("keys"), F.col("t.bytes").alias("bytes"), F.struct(F.col("a0").alias("a"), F.col("b0").alias("b")).alias("before"), "size"), "paths")


def summed(nodes: DataFrame, way: DataFrame, height: int) -> DataFrame:
    """nodes (conv_id: a member, i: depth, a, b: key, v: values) and way (conv_id, band, keys: of the
    prefixes of each band of a conversation) -> a, b, i and s, the sums of v over each node's subtree."""
    add = lambda c: F.struct(*[F.sum(f"{c}.{x}").alias(x) for x in ("leaves", "saved")])
    place = F.expr(f"band * {height}") + F.col("p")
    to_band = nodes.withColumn("band", F.expr(f"i div {height}")).select("conv_id", "band", "i", "v")
    shared = to_band.join(way, ["conv_id", "band"])
    up = shared.select("v", "band", F.posexplode(F.slice("keys", 1, F.expr(f"int(i % {height}) + 1"))).alias("p", "k"))
    local = up.groupBy("k.a", "k.b", place.alias("i")).agg(add("v").alias("s"))
    if (nodes.agg(F.max("i")).first()[0] or 0) < height:
        return local
    local = stored(local, "band-totals")
    tops = nodes.where(F.col("i") % height == 0).join(local, ["a", "b", "i"]).select("conv_id", F.expr(f"i div {height}").alias("i"), "a", "b", F.col("s").alias("v"))
    tops = stored(tops, "band-tops")
    mine = way.join(tops.select("conv_id").distinct(), "conv_id", "left_semi")
    steps = mine.select("conv_id", F.expr(f"band div {height}").alias("over"), "band", F.col("keys")[0].alias("k"))
    above = steps.groupBy("conv_id", "over").agg(F.sort_array(F.collect_list(F.struct("band", "k"))).alias("x")).select("conv_id", F.col("over").alias("band"), F.col("x.k").alias("keys"))
    done = summed(tops, stored(above, "band-ways"), height)
    whole = tops.drop("v").join(done, ["a", "b", "i"]).where("i > 0").select("conv_id", (F.col("i") - 1).alias("band"), "s")
    down = whole.join(way, ["conv_id", "band"]).select("s", "band", F.posexplode("keys").alias("p", "k"))
    more = down.select("k.a", "k.b", place.alias("i"), "s")
    return local.unionByName(more).groupBy("a", "b", "i").agg(add("s").alias("s"))


def digests(way: DataFrame, height: int) -> DataFrame:
    """a, b, depth and ends_sha256 of the nodes at which conversations end. A digest is taken in the
    order of the ids, so one task reads a node's list, as pieces of PIECE ids, one after the other."""
    last = F.element_at("keys", F.expr(f"int(size % {height}) + 1"))
    ends = way.where(F.col("band") == F.expr(f"size div {height}")).select(last.alias("k"), F.col("size").alias("depth"), "conv_id")
    piece = F.floor(F.col("conv_id") / PIECE)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("k.a", "k.b", "depth", piece.alias("piece")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "depth", "ends_sha256"]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)
        key, sha = None, hashlib.sha256()
        for batch in batches:
            rows = []
            for *now, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "depth", "ids"))):
                if now == key:
                    sha.update(b"," + text.encode())
                    continue
                if key is not None:
                    rows.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256(text.encode())
            if rows:
                yield flush(rows)
        if key is not None:
            yield flush([(*key, sha.hexdigest())])

    dealt = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "depth", "piece")
    return dealt.select("a", "b", "depth", "ids").mapInArrow(run, "a long, b long, depth long, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. Parents of many nodes meet their children by broadcast: as children
    are nodes, fewer than SHARE parents can have more than a SHARE-th of all nodes as children."""
    many = nodes.count() / SHARE
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    key = ["pa", "pb", "depth"]
    hot = nodes.join(F.broadcast(parents.where(F.col("n_children") > many).drop("n_children")), key, "left")
    settled = F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0)
    rest = hot.where(~settled).drop("parent_conv_id").join(parents.where(F.col("n_children") <= many).drop("n_children"), key)
    return hot.where(settled).unionByName(rest)


def trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """turns as for paths() -> the trie's nodes, see prefix_trie()."""
    way = paths(turns, height)
    steps = way.select("conv_id", "band", "before", "keys", F.posexplode(F.arrays_zip("keys", "bytes")).alias("p", "x"))
    above = F.when(F.col("p") == 0, F.col("before")).otherwise(F.get("keys", F.col("p") - 1))
    steps = steps.select("conv_id", (F.col("band") * height + F.col("p")).alias("depth"), "x.keys.a", "x.keys.b", "x.bytes", above["a"].alias("pa"), above["b"].alias("pb"))
    nodes = steps.groupBy("a", "b", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("bytes", "pa", "pb")])
    nodes = stored(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["a", "b", "depth"], "left").fillna(0, ["n_children"]), "parents")
    own = F.struct(F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = summed(nodes.select("conv_id", F.col("depth").alias("i"), "a", "b", own.alias("v")), way.select("conv_id", "band", "keys"), height)
    totals = totals.select("a", "b", F.col("i").alias("depth"), F.col("s.leaves").alias("n_leaves"), F.col("s.saved").alias("saved_tokens"))
    out = with_parents(nodes).join(totals, ["a", "b", "depth"]).join(digests(way, height), ["a", "b", "depth"], "left")
    none = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def rooted(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns (conv_id, pos, e, bytes, size) with a root row for each of convs (conv_id, size)."""
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("e"), F.lit(0).cast("long").alias("bytes"), "size")
    return turns.unionByName(roots)


def prefix_trie(turns: DataFrame, height: int = HEIGHT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all conversations of a table, a row for each different sequence of first turns:
    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (of its
    subtree), saved_tokens (bytes that sharing its subtree's texts saves) and ends_sha256 (of the
    ids of the conversations that end there).

    Rows of null conv_id take no part; null turns come first, equal ones in an order of their digests;
    repeated rows are turns of their own; null roles and texts are empty. Other columns are left out,
    an empty table gives no nodes."""
    rows = stored(numbered(turns, conv_id, turn, role, text), "numbered")
    convs = rows.where("o = 1").select("conv_id", F.col("turns").alias("size"))
    return trie(rooted(rows.select("conv_id", F.col("o").alias("pos"), "e", "bytes", F.col("turns").alias("size")), convs), height)


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns exchanged for those of c - c % 5 (all there are, if
    fewer), h being crc32 of its decimal id modulo 9; as turns for trie()."""
    rows = stored(numbered(turns), "numbered")
    convs = rows.where("o = 1").select("conv_id", "turns", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    kept = F.least("h", F.coalesce("base_turns", F.lit(0)))
    size = kept + F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    convs = stored(convs.join(heads, "base", "left").select("conv_id", "base", "h", kept.alias("kept"), size.alias("size")), "conversations")
    # a conversation of many turns keeps its own beyond the first few: cut it in runs for the join
    run, runs = F.expr(f"o div {WIDE}"), F.sequence(F.lit(0).cast("long"), F.expr(f"(size + h) div {WIDE}"))
    own = rows.where("o > 0").withColumn("run", run).join(convs.withColumn("run", F.explode(runs)), ["conv_id", "run"]).where("o > h").select("conv_id", (F.col("kept") + F.col("o") - F.col("h")).alias("pos"), "e", "bytes", "size")
    first = rows.where("o <= 8 AND conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("o").alias("pos"), "e", "bytes")
    shared = first.join(convs, "base").where("pos <= kept").select("conv_id", "pos", "e", "bytes", "size")
    return rooted(own.unionByName(shared), convs)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations, over the whole table."""
    return trie(rebuilt(table(spark, sf_dir, "conversations")))
