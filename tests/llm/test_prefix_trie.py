"""The trie against a brute-force version that lists every prefix."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hearthgraph.llm import prefix_trie as pt

KIND = "conv_id long, turn long, role string, text string"


def talks(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            e = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            out[c].append(((turn is not None, turn or 0), e, (role, text)))
    return {c: [x for _, _, x in sorted(t)] for c, t in out.items()}


def mixed(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1].encode()) if n else 0
    for n, who in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        yield min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], leaves[n], saved[n], sha


def made(seed, n=60, longest=9):
    rnd = random.Random(seed)
    for c in range(-3, n):
        for turn in range(rnd.choice([1, 2, 4, longest])):
            yield c, rnd.choice([turn, turn, None]) if turn else 0, rnd.choice(["user", None]), rnd.choice(["ä", "bb", "", None])


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [x for x, _ in df.dtypes] == names and {t for _, t in df.dtypes} == {"bigint", "string"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def want(convs):
    return sorted(brute(convs), key=str)


@pytest.mark.parametrize("height,longest", [(2, 30), (3, 60), (16, 40)])
def test_rebuilt_and_plain_tries(spark, monkeypatch, height, longest):
    """Bands in bands, windows of bands, pieces of lists of ids, hot parents."""
    for name, value in (("HEIGHT", height), ("WIDE", 4), ("PIECE", 3), ("SHARE", 30)):
        monkeypatch.setattr(pt, name, value)
    rows = list(made(height, longest=longest))
    turns = spark.createDataFrame(rows, KIND).repartition(3)
    assert got(pt.prefix_trie(turns, height)) == want(talks(rows))
    assert got(pt.trie(pt.rebuilt(turns), height)) == want(mixed(talks(rows)))


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    """A chain of four levels of bands, and a node at which most conversations end."""
    rows = [(7, i, "user", f"t{i % 3}") for i in range(300)] + [(c, i, "user", f"t{i}") for c in range(10, 60) for i in range(2)]
    turns = spark.createDataFrame(rows, KIND)
    monkeypatch.setattr(pt, "PIECE", 8)
    assert got(pt.prefix_trie(turns, 4)) == want(talks(rows))


def test_numbers_do_not_depend_on_the_tasks(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    seen = set()
    for n in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.add(tuple(sorted(pt.numbered(rows).select("conv_id", "o", "turns", F.hex("e"), "bytes").collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(pt.op12_conversation_trie(spark, sf)) == want(mixed(talks(rows)))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (1, 1, "user", "long " * 50_000), (1, 1, "user", "long " * 50_000), (2, None, None, None), (2, 0, "", ""), (5, 3, "user", "x"), (6, 1, "us", "erx"), (7, 1, "user", "x")]
    extra = ", ".join(f"{c} string" for c in ("o", "e", "bytes", "size", "band", "a", "at", "task", "s"))
    turns = spark.createDataFrame([(*r, *"abcdefghi") for r in rows], f"{KIND}, {extra}")
    assert got(pt.prefix_trie(turns)) == want(talks(rows))
    assert got(pt.trie(pt.rebuilt(turns))) == want(mixed(talks(rows)))
    assert pt.prefix_trie(turns.limit(0)).count() == 0 and pt.trie(pt.rebuilt(turns.limit(0))).count() == 0
