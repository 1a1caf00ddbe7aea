import numpy as np
import pytest

from hearthgraph.llm import exact_topk, learned_partitions


def brute(rows, score, k=20):
    """rows (id, vector): the k best of each id divisible by 20, own id left out."""
    out = {}
    for q, a in rows:
        if q % 20 == 0:
            best = sorted(((-score(a, b), i) for i, b in rows if i != q))[:k]
            out[q] = [(r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def whole(a, b):
    return int(sum(int(np.floor(64.0 * x)) * int(np.floor(64.0 * y)) for x, y in zip(a, b)))


@pytest.fixture
def scattered(spark):
    """Each block in a task of its own: sides that hash differently would not meet."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [(r.vec_id, [float(x) for x in r.embedding]) for r in e]


def test_exact_top_k_on_the_table(spark, sf):
    rows = vectors(spark, sf)
    z = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows}
    got = collected(exact_topk.op1_exact_top_k(spark, sf))
    ids = np.array(sorted(z))
    m = np.stack([z[i] for i in ids])
    assert set(got) == {i for i in z if i % 20 == 0}
    for q, found in got.items():
        s = m @ z[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        assert found == [(r, int(ids[j]), int(s[j])) for r, j in enumerate(order, 1)]


def test_the_cutoff_saves_reading():
    """Lists are scored once, and only survivors' missing components are fetched."""
    rnd = np.random.RandomState(5)
    a, b = (np.floor(64 * rnd.randn(n, 32) / 5) for n in (40, 3000))
    b *= np.where(np.arange(3000) % 3 == 0, 4, 1)[:, None]  # lengths differ, so lists end early
    total = a @ b.T
    low = np.sort(total, 1)[:, -60].astype(float)  # a bound from heads is below the 20th best
    read = exact_topk.Read()
    got = {(r, c): t for rows in exact_topk.Lists(b).resolve(a, low, read) for r, c, t in zip(*rows)}
    assert {k: v for k, v in got.items() if v >= low[k[0]]} == {(r, c): total[r, c] for r, c in zip(*np.nonzero(total >= low[:, None]))}
    everything = a.shape[0] * b.shape[0]
    assert read.scored < 2 * everything * 0.95
    assert read.collected < everything * 0.25
    assert read.fetched <= read.collected * 16 and read.fetched < everything * 32 * 0.05
    none = exact_topk.Read()
    assert sum(len(r) for r, _, _ in exact_topk.Lists(b).resolve(a, np.full(40, -np.inf), none)) == everything and none.fetched == 0


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 7)])
def test_exact_top_k_with_ties_copies_and_odd_rows(spark, monkeypatch, scattered, blocks):
    monkeypatch.setattr(exact_topk, "QUERIES", blocks[0])
    monkeypatch.setattr(exact_topk, "CANDIDATES", blocks[1])
    monkeypatch.setattr(exact_topk, "HEADS", blocks[1] // 4)
    rnd = np.random.RandomState(0)
    rows = [(i, [float(x) for x in rnd.randint(-1, 2, 3)]) for i in range(90)] + [(i, [1.0, 0.5, -1.0]) for i in range(90, 170)]
    odd = [(200, None), (201, [None, 1.0, 1.0]), (202, [float("nan"), 1.0, 1.0]), (220, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1.0, 7) for i, v in rows + odd + rows[:5]], "vec_id long, embedding array<double>, score double, rank int")
    assert collected(exact_topk.top_k(df)) == brute(rows, whole)
    few = [(0, [1.0]), (1, [2.0, 3.0]), (2, [])]
    assert collected(exact_topk.top_k(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == {0: [(1, 1, 8192), (2, 2, 0)]}
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**29 + i, -(2.0**28), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, whole(a, b)))
    assert collected(exact_topk.top_k(df)) == brute(rows, cut)


def recall(found, rows):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0].tolist():
        s = m @ m[ids == q][0]
        order = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        got = [i for _, i, _ in found[q]]
        assert len(got) == 20 and q not in got and [r for r, _, _ in found[q]] == list(range(1, 21))
        assert [x for _, _, x in found[q]] == sorted((x for _, _, x in found[q]), reverse=True)
        assert np.allclose([x for _, _, x in found[q]], [m[ids == q][0] @ m[ids == i][0] for i in got], rtol=0, atol=1e-12)
        hit, total = hit + len(set(order) & set(got)), total + 20
    return hit / total


@pytest.mark.parametrize("blocks", [(2048, 8192), (9, 40)])
def test_recall_against_brute_force(spark, sf, monkeypatch, scattered, blocks):
    monkeypatch.setattr(learned_partitions, "QUERIES", blocks[0])
    monkeypatch.setattr(learned_partitions, "CANDIDATES", blocks[1])
    rows = vectors(spark, sf)
    assert recall(collected(learned_partitions.op3_learned_partitions(spark, sf)), rows) >= 0.9


@pytest.mark.parametrize("part", [400, 60])
def test_recall_with_parts_inside_parts(spark, monkeypatch, part):
    """Leaves keep their size as the table grows, and a query still reads a part of it only."""
    rnd = np.random.RandomState(part)
    centres = rnd.randn(150, 16)
    rows = [(i, (centres[rnd.randint(150)] + rnd.randn(16) * 0.15).tolist()) for i in range(6000)]
    monkeypatch.setattr(learned_partitions, "PART", part)
    monkeypatch.setattr(learned_partitions, "MOST_PARTS", 16)
    monkeypatch.setattr(learned_partitions, "SAMPLE", 2000)
    seen = []
    own = learned_partitions.fit_inner
    monkeypatch.setattr(learned_partitions, "fit_inner", lambda *a: seen.append(own(*a)) or seen[-1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(collected(learned_partitions.nearest(df)), rows) >= 0.9
    assert bool(seen[0]) == (part == 60)


def test_clusters_need_few_probes():
    rnd = np.random.RandomState(1)
    centres = rnd.randn(16, 32) * 3
    x = centres[rnd.randint(0, 16, 4000)] + rnd.randn(4000, 32) * 0.3
    index = learned_partitions.fit(x, 16)
    assert index.probes <= 4
    sizes = np.bincount(index.ranked(x)[:, 0], minlength=16)
    assert sizes.max() < 0.3 * len(x)


def test_nearest_on_odd_rows(spark):
    rows = [(i, [float(i % 7), 1.0, -0.5 * (i % 3)]) for i in range(30)] + [(i, [6.0, 1.0, 0.0]) for i in range(40, 200)]
    odd = [(220, None), (221, [None, 1.0, 1.0]), (240, [0.0, 0.0, 0.0]), (222, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1.0, 7) for i, v in rows + odd + rows[:5]], "vec_id long, embedding array<double>, score double, rank int")
    assert collected(learned_partitions.nearest(df)) == brute(rows, lambda a, b: sum(x * y for x, y in zip(a, b)))
    assert learned_partitions.nearest(df.limit(0)).count() == 0
