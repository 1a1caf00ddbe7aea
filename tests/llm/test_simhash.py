import random
import re

import numpy as np
import xxhash

from hearthgraph.llm import simhash
from hearthgraph.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows (id, fp): the smallest id that each reaches."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            r = find(f)
            least[r] = min(i, least.get(r, i))
    return {(i, f, least.get(find(f))) for i, f in rows}


def test_fingerprints():
    rnd = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " \t\n".join(rnd.choice(["Ab", "É", "cd", "x y", "日"]) for _ in range(n))
        assert simhash.fingerprint(t) == brute_fingerprint(t) == simhash.fingerprint(t, 7)
    assert simhash.fingerprint(None) == 0


def test_index_finds_every_pair():
    rnd = np.random.RandomState(4)
    for n in (1, 15, 16, 17, 300, 900):
        base = rnd.randint(0, 1 << 62, 6, dtype=np.uint64)
        fps = np.unique([int(rnd.choice(base)) ^ sum(1 << int(b) for b in rnd.choice(64, rnd.randint(0, 4), False)) for _ in range(n)]).astype(np.uint64)
        fps = fps[np.argsort(simhash.gray_rank(fps))]
        i, j = simhash.near_pairs(fps)
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 2}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_links_over_both_levels(spark, monkeypatch):
    rnd = random.Random(9)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(700)} | {rnd.getrandbits(64) for _ in range(300)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = {f: c for f, _, c in brute_components([(f, f) for f in fps])}
    for wide in (2048, 20):
        monkeypatch.setattr(simhash, "WIDE", wide)
        found = components(simhash.links(spark.createDataFrame(signed, "fp long")))
        groups = {}
        for r in found.collect():
            groups.setdefault(r.root, set()).add(r.node % (1 << 64))
        expect = {}
        for f, c in want.items():
            expect.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(x) for x in expect.values() if len(x) > 1)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 160)} | {(200, 200), (201, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_components([(d.doc_id, brute_fingerprint(d.text)) for d in docs.collect()])
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {i for i, _, c in want if i == c}


def test_odd_rows(odd, odd_rows):
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(odd).collect()), key=str)
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in odd_rows])
    assert set(got) == want and len(got) == len(odd_rows)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "7", "None"]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rnd = random.Random(12)
    long = lambda: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(300))

    def near(text):
        """A text of another fingerprint that links to this one's."""
        words = text.split()
        while True:
            words[rnd.randrange(300)] = f"v{rnd.randint(0, 10**6)}"
            t, words = " ".join(words), text.split()
            if 0 < (simhash.fingerprint(t) ^ simhash.fingerprint(text)).bit_count() <= 2:
                return t

    a, clean, other, unnamed = long(), [long() for _ in range(6)], long(), long()
    rows = [(1, a), *((i, t) for i, c in enumerate(clean, 10) for t in (near(a), c)), (30, other), (None, near(other)), (None, unnamed), (None, near(unnamed)), (None, near(unnamed)), (None, unnamed)]
    for parts in (1, 4):
        got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.text) for r in got if r.doc_id) == sorted([(1, a), *enumerate(clean, 10), (30, other)])
        assert len([r for r in got if r.doc_id is None]) == 1 and len(got) == 9
