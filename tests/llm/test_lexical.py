"""Ranked lexical search against scores of every document, and interval by interval."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hearthgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """docs, items: rows (id, text)."""
    rows = [(i, Counter(t)) for i, x in docs if (t := brute_terms(x))]
    n, total = len(rows), sum(sum(t.values()) for _, t in rows)
    df = Counter(x for _, t in rows for x in t)
    for item, text in items:
        scored = []
        asked = Counter(brute_terms(text))
        for i, t in rows:
            m = 100 - 25 + (25 * sum(t.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * t[x]) // (1000 * t[x] + 12 * m)) for x, q in asked.items() if x in t)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            yield item, rank, i, -s


def test_terms():
    rnd = random.Random(3)
    for _ in range(500):
        t = "".join(rnd.choice("aZ09 é日\n/:@[`{~\x7f\x80 İK_-") for _ in range(40))
        assert [x.decode() for x in lexical.terms(t)] == brute_terms(t)
    assert lexical.terms(None) == []


def made(n, seed, words=30):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    return [(i, " ".join(rnd.choices(vocab, [1 / (j + 1) for j in range(words)], k=rnd.choice([0, 1, 5, 30, 200])))) for i in range(n)]


def segment_of(rows, wanted):
    seg = lexical.Segment()
    for i, t in rows:
        w = lexical.terms(t)
        if w:
            seg.add(i, len(w), [(x, c) for x, c in Counter(w).items() if x in wanted])
    return seg.row(pa.int64())


@pytest.mark.parametrize("batch", [1, 3, 24])
def test_intervals_of_one_segment(batch):
    """Any batch gives the whole answer, ties included, and a high floor saves splits."""
    docs = made(400, batch)
    weights = {f"w{i}": 100 + 37 * i for i in range(0, 30, 2)}
    row = segment_of(docs, {x.encode() for x in weights})
    col = lambda c: row.column(c).flatten()
    lists = lexical.Lists(col("sizes").to_numpy(), col("terms").to_pylist(), col("lengths").to_numpy(), col("at").to_numpy(), col("tf").to_numpy(), row["docs"][0].as_py(), row["total"][0].as_py())
    n, total = row["docs"][0].as_py(), row["total"][0].as_py()
    scored = []
    for i, t in docs:
        c = Counter(t.split())
        m = 75 + (25 * sum(c.values()) * n) // total
        s = sum(w * ((10**9 * c[x]) // (1000 * c[x] + 12 * m)) for x, w in weights.items() if c[x])
        if s:
            scored.append((-s, i))
    for k in (1, 5, 20, 500):
        found = lexical.Found(k)
        first = lexical.search(lists, col("ids").to_pylist(), list(weights.items()), found, batch)
        assert [(s, i) for s, _, i in found.rows] == sorted(scored)[:k]
        again = lexical.search(lists, col("ids").to_pylist(), list(weights.items()), lexical.Found(k), batch)
        assert first == again
        if k == 1:
            assert first < len(scored) / 2


def test_range_maxima():
    rnd = np.random.RandomState(1)
    lengths = np.array([1, 7, 64, 3])
    at = np.concatenate([np.sort(rnd.choice(100, n, False)) for n in lengths])
    lists = lexical.Lists(rnd.randint(1, 90, 100), ["a", "b", "c", "d"], lengths, at, rnd.randint(1, 9, lengths.sum()), 100, 5000)
    for a, z in zip(lists.start, lists.stop):
        lo, hi = np.array([(i, j) for i in range(a, z) for j in range(i + 1, z + 1)]).T
        best = lists.impact[lists.best(lo, hi)]
        assert best.tolist() == [lists.impact[i:j].max() for i, j in zip(lo, hi)]


@pytest.mark.parametrize("segment,postings,block", [(8192, 1 << 19, 1 << 18), (7, 1 << 19, 20), (50, 40, 1)])
def test_segments_and_blocks(spark, monkeypatch, segment, postings, block):
    monkeypatch.setattr(lexical, "SEGMENT", segment)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = made(300, 8), made(9, 5)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in lexical.ranked(d, q).collect()) == sorted(brute(docs, items))


def test_terms_that_share_a_bit_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BITS", 64)
    docs, items = made(200, 2, 90), made(6, 4)
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items, 7))


def test_query_on_the_whole_table(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(tuple(r) for r in lexical.op11_lexical_search(spark, sf).collect()) == sorted(brute(docs, items))


def test_odd_rows(spark, odd, odd_rows):
    """Nulls, empty, long and repeated documents; null, empty and repeated items, two texts of one id."""
    docs = [(i, t) for i, t, _ in odd_rows]
    items = [(1, "the Mat word"), (1, "the Mat word"), (2, None), (3, ""), (None, "a id HERE"), (4, "日本語 naïve"), (4, "word")]
    q = spark.createDataFrame([(*x, "t", 1) for x in items], "item_id long, text string, term string, n int")
    key = lambda r: str(r)
    got = sorted((tuple(r) for r in lexical.ranked(odd, q).collect()), key=key)
    assert got == sorted(brute(docs, list(dict.fromkeys(items))), key=key)
    assert lexical.ranked(odd.limit(0), q).count() == 0 and lexical.ranked(odd, q.limit(0)).count() == 0
