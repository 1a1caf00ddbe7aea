"""The three resolving jobs on the table, against a model: every pair of a block scored, the veto and
the greedy rule in plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hearthgraph.operators import jobs as W
from hearthgraph.operators import linkage as L
from hearthgraph.sources import testdata as T

BLOCK = ["outcode", "bedrooms"]
COLUMNS = ["unique_id", "source", "price_pcm", "bedrooms", "outcode", "street", "full_postcode", "latitude", "longitude", "first_seen"]


@pytest.fixture(scope="module")
def table(spark, sf):
    return T.listings(spark, sf).cache(), T.images(spark, sf).cache()


def photos(rows, images):
    own = defaultdict(list)
    for r in images.where("image_type = 'gallery' and phash is not null").select("unique_id", "image_id", "phash").collect():
        own[r.unique_id].append((r.image_id, int(r.phash, 16)))
    return {r.unique_id: [h for _, h in sorted(own[r.unique_id])] or ([int(r.phash, 16)] if r.phash else []) for r in rows.select("unique_id", "phash").collect()}


def alike(a, b):
    left = list(b)
    for x in a:
        hit = next((i for i, y in enumerate(left) if (x ^ y).bit_count() <= 8), None)
        if hit is not None:
            del left[hit]
    return len(b) - len(left)


def model(rows, images):
    """record -> first record of its group, for those that are grouped."""
    hashes = photos(rows, images)
    # all but the photos' points, by Spark over all pairs of a block
    scored = L.match_score(L.candidate_pairs(L.keyed(rows).select(COLUMNS), BLOCK))
    found = []
    for r in scored.select("unique_id_a", "unique_id_b", "source_a", "source_b", "first_seen_a", "first_seen_b", "score", "signal_count").collect():
        n = alike(hashes[r.unique_id_a], hashes[r.unique_id_b])
        score, signals = r.score + 20.0 * min(2, n), r.signal_count + (n > 0)
        if score >= 60 and signals >= 2 and (n or not (hashes[r.unique_id_a] and hashes[r.unique_id_b])):
            x, y = sorted([(r.first_seen_a, r.unique_id_a, r.source_a), (r.first_seen_b, r.unique_id_b, r.source_b)])
            found.append((-score, x, y))
    group, members, sources = {}, {}, {}
    for _, x, y in sorted(found):
        (a, sa), (b, sb) = x[1:], y[1:]
        if a in group and b in group:
            continue
        if a not in group and b not in group:
            group[a] = group[b] = a
            members[a], sources[a] = [a, b], {sa, sb}
            continue
        g, new, source = (group[a], b, sb) if a in group else (group[b], a, sa)
        if len(members[g]) < 4 and source not in sources[g]:
            group[new] = g
            members[g].append(new)
            sources[g].add(source)
    return group


def test_resolve_entities(table):
    rows, images = table
    group = model(rows, images)
    want = defaultdict(set)
    for r in rows.select("unique_id", "source").collect():
        want[group.get(r.unique_id, r.unique_id)].add(r.source)
    got = {r.group_id: set(r.sources) for r in L.resolve_entities(rows, images=images).collect()}
    assert got == want and sum(len(s) > 1 for s in want.values()) > 20


def test_resolve_existing(table):
    rows, images = table
    group = model(rows, images)
    seen = {r.unique_id: (r.first_seen, r.unique_id) for r in rows.select("unique_id", "first_seen").collect()}
    by = defaultdict(list)
    for m, g in group.items():
        by[g].append(seen[m])
    want = {(u, min(ms)[1]) for ms in by.values() for _, u in ms if u != min(ms)[1]}
    out = W.resolve_existing(rows, images, children={"images": (images, "unique_id")})
    assert {(r.absorbed, r.kept) for r in out["absorbed"].collect()} == want and want
    gone = {a for a, _ in want}
    assert {r.unique_id for r in out["images"].select("unique_id").distinct().collect()} == {r.unique_id for r in images.select("unique_id").distinct().collect()} - gone


def test_resolve_against_anchors(table):
    rows, images = table
    new, anchors = rows.where("k >= 2"), rows.where("k < 2")
    retry = {r.unique_id for r in new.where("attempts > 1").collect()}
    recent = anchors.where(F.col("first_seen") >= F.lit("2025-01-30").cast("timestamp"))
    group = model(new.unionByName(recent), images)
    info = {r.unique_id: r for r in rows.select("unique_id", "source", "first_seen", "price_pcm").collect()}
    old = {r.unique_id for r in recent.collect()}
    by = defaultdict(set)
    for u in [r.unique_id for r in new.collect()] + sorted(old):
        by[group.get(u, u)].add(u)
    want = {}
    for g, us in by.items():
        order = sorted(us, key=lambda u: (info[u].first_seen, u))
        mine = [u for u in order if u in old]
        brings = bool(mine) and bool({info[u].source for u in us - old} - {info[mine[0]].source})
        for u in us - old:
            first = not mine and order[0] == u
            fate = "genuinely_new" if first else "consumed_retry" if u in retry else "merged_into_anchor"
            change = min(info[x].price_pcm for x in us - old) - info[mine[0]].price_pcm if brings else None
            want[u] = (mine[0] if mine else None, fate, brings, change or None)
    out = W.resolve_against_anchors(new, anchors, images=images, as_of=F.lit("2025-03-01").cast("timestamp"), retries=new.where("attempts > 1"))
    assert {r.unique_id: (r.anchor_id, r.fate, r.reanalyse, r.price_change) for r in out.collect()} == want
    assert {"genuinely_new", "consumed_retry", "merged_into_anchor"} <= {w[1] for w in want.values()}
