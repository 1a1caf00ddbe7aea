"""Invariants of linkage, and models in plain Python where SQL cannot say what is computed."""

import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthgraph.functions import address as A
from hearthgraph.functions import geo as G
from hearthgraph.functions import text as X
from hearthgraph.operators import linkage as L
from hearthgraph.plans import registry
from hearthgraph.sources import testdata as T

NAMES = [f"{s}:{i}" for s in ("a", "b", "c", "d", "e") for i in range(4)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(NAMES), st.sampled_from(NAMES)), max_size=40))
def test_groups_keep_their_limits(pairs):
    rows = [(a, b, a[0], b[0]) for a, b in pairs if a[0] != b[0]]
    found = L.greedy_groups(rows)
    members = defaultdict(list)
    for m, g in found.items():
        members[g].append(m)
    for g, ms in members.items():
        assert 2 <= len(ms) <= L.GROUP_AT_MOST and g in ms
        assert len({m[0] for m in ms}) == len(ms)
    assert set(found) <= {x for r in rows for x in r[:2]}


def test_resolution_loses_nothing_and_repeats_no_source(spark, sf):
    rows = T.listings(spark, sf)
    golden = L.resolve_entities(rows).select("members", F.size("sources").alias("n")).collect()
    assert sum(r.members for r in golden) == rows.count()
    assert all(r.members == r.n <= 4 for r in golden)


def test_strong_pairs_lose_no_match(spark, sf):
    rows = L.keyed(T.listings(spark, sf)).select("unique_id", "source", "price_pcm", "bedrooms", "outcode", "street", "full_postcode", "latitude", "longitude", "phash")
    key = lambda p: {(r.unique_id_a, r.unique_id_b) for r in L.match_score(L.with_photo(p)).where("is_match").collect()}
    block = ["outcode", "bedrooms"]
    assert key(L.strong_pairs(rows, block)) == key(L.candidate_pairs(rows, block)) == key(L.candidate_pairs(rows, block, salts=3))


def test_bands_find_all_near_hashes(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    rows = [(i, f"{rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 10))):016x}") for i in range(150)]
    df = spark.createDataFrame(rows, "id int, h string")
    a, b = df.select(F.col("id").alias("ia"), F.col("h").alias("ha")), df.select(F.col("id").alias("ib"), F.col("h").alias("hb"))
    got = {(r.ia, r.ib, r.distance) for r in L.hamming_join(a, b, "ha", "hb").collect()}
    want = {(i, j, d) for i, x in rows for j, y in rows if (d := (int(x, 16) ^ int(y, 16)).bit_count()) <= 8}
    assert got == want


def greedy_count(a, b, near, best):
    used = set()
    for x in a:
        free = [(near(x, y), j) for j, y in enumerate(b) if j not in used and near(x, y) is not None]
        if free:
            used.add(min(free, key=lambda s: (-s[0], s[1]))[1] if best else min(j for _, j in free))
    return len(used) if a and b else 0


def test_gallery_counts_against_a_model(spark, sf):
    photos = defaultdict(list)
    for r in T.images(spark, sf).orderBy("phash").collect():
        photos[r.unique_id].append(int(r.phash, 16))
    near = lambda x, y: 0 if (x ^ y).bit_count() <= 8 else None
    for r in registry.QUERIES["gallery_match_count"](spark, sf).collect():
        assert r.matches == greedy_count(photos[r.id_a], photos[r.id_b], near, False)


def test_embedding_counts_against_a_model(spark, sf):
    groups = defaultdict(list)
    for r in T.read(spark, sf, "embeddings").orderBy("vec_id").collect():
        groups[r.vec_id // 4].append([float(x) for x in r.embedding])

    def near(x, y):
        c = sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
        return c if c >= 0.2 else None

    for r in registry.QUERIES["embedding_match_count"](spark, sf).collect():
        assert r.matches == greedy_count(groups[r.item], groups[r.item + 1], near, True)


CASES = [("Flat 2, The Towers, Mare Street", "mare street"), ("2a Mare St", "mare street"), ("Building Name, 123 Mare Street, London", "mare street"), ("The Grove near Hackney", "grove near")]


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


@pytest.mark.parametrize("address,street", CASES[:3])
def test_streets(spark, address, street):
    assert one(spark, a=address).select(A.normalize_street_name(F.col("a"))).first()[0] == street


@pytest.mark.parametrize("text,yes", [("E8", True), ("N15", True), ("SW1A", True), ("e8", True), (" E8 ", True), ("E8 3RH", False), ("EEE1", False), ("E123", False), ("hackney", False), ("", False)])
def test_outcodes(spark, text, yes):
    assert one(spark, a=text).select(A.is_outcode(F.col("a"))).first()[0] is yes


@pytest.mark.parametrize("text,price", [("£2,300 pcm", 2300), ("£500 pw", 2166), ("£2,400 pcm £554 pw", 2400), ("POA", None)])
def test_prices(spark, text, price):
    assert one(spark, a=text).select(X.extract_price(F.col("a"))).first()[0] == price


@pytest.mark.parametrize("a,b,value", [(1000, 1000, 1.0), (0, 0, 1.0), (0, 500, 0.0), (985, 1015, 0.5), (970, 1030, 0.0)])
def test_price_closeness(spark, a, b, value):
    assert one(spark, a=a, b=b).select(G.graduated_price(F.col("a"), F.col("b"))).first()[0] == pytest.approx(value)


def test_distance_closeness(spark):
    df = spark.createDataFrame([(0.0, 1.0), (50.0, 0.5), (75.0, 0.25), (100.0, 0.0), (900.0, 0.0)], "d double, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.select("want", G.graduated(F.col("d"), 50.0, 100.0).alias("got")).collect())


def test_token_ratios(spark):
    df = spark.createDataFrame([("b a", "a b", 1.0, 1.0), ("abcd", "abxd", 0.75, 0.75), ("two bed flat", "flat", 0.5, 1.0), ("", "", 1.0, 1.0)], "x string, y string, s double, t double")
    got = df.select("s", "t", L.token_ratio("sort")(F.col("x"), F.col("y")).alias("gs"), L.token_ratio("set")(F.col("x"), F.col("y")).alias("gt")).collect()
    assert all(r.gs == pytest.approx(r.s) and r.gt == pytest.approx(r.t) for r in got)


@pytest.mark.parametrize("most", [0, 2, 5, 8, 10])
def test_hamming_join_is_brute_force(spark, most):
    rnd = random.Random(most)
    base = [rnd.getrandbits(64) for _ in range(25)]
    rows = [(0, None, 1), (1, "0" * 16, None)]
    for i in range(2, 160):
        h = rnd.choice(base)
        for _ in range(rnd.randint(0, 9)):
            h ^= 1 << rnd.randrange(64)
        rows += [(i, f"{h:016x}", i % 3)] * (1 + (i % 40 == 0))  # some rows twice
    df = spark.createDataFrame(rows, "i int, h string, k int")
    a, b = L._sides(df)
    for key in (False, True):
        got = L.hamming_join(a, b, "h_a", "h_b", most, ["k_a"] if key else None, ["k_b"] if key else None)
        bits = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
        want = sorted((i, j, bits(x, y)) for i, x, k in rows if x for j, y, m in rows if y and (not key or (k == m is not None)) and bits(x, y) <= most)
        assert sorted((r.i_a, r.i_b, r.distance) for r in got.collect()) == want


@pytest.mark.parametrize("rounds_above", [0, 15, 10**6])
def test_grouping_is_the_greedy_rule(spark, rounds_above):
    """By component in tasks, in rounds over the cluster, and both: the model's groups."""
    rnd = random.Random(9)
    ids = [(f"{s}{i}", s, i % 7) for s in "abcde" for i in range(24)]
    rows = {}
    for _ in range(150):
        x, y = sorted(rnd.sample(ids, 2), key=lambda r: (r[2], r[0]))
        if x[1] != y[1] and abs(int(x[0][1:]) - int(y[0][1:])) < 4:
            rows[x[0], y[0]] = (float(rnd.choice([60, 70, 80])), x, y)
    model = sorted(rows.values(), key=lambda r: (-r[0], r[1][2], r[1][0], r[2][2], r[2][0]))
    want = L.greedy_groups([(x[0], y[0], {x[1]}, {y[1]}) for _, x, y in model])
    flat = [(y[0], [y[1]], y[2], x[0], [x[1]], x[2], s) if rnd.random() < 0.5 else (x[0], [x[1]], x[2], y[0], [y[1]], y[2], s) for s, x, y in model]
    df = spark.createDataFrame(flat, "unique_id_a string, sources_a array<string>, first_seen_a int, unique_id_b string, sources_b array<string>, first_seen_b int, score double")
    assert {r.unique_id: r.group_id for r in L.group_matches(df, None, rounds_above).collect()} == want and len(want) > 40
    # blocks of records that no pair joins, some of them too full for one task
    blocks = df.withColumn("block_a", F.when(F.substring("unique_id_a", 2, 9).cast("int") < 12, "x").otherwise("y")).where((F.substring("unique_id_a", 2, 9).cast("int") < 12) == (F.substring("unique_id_b", 2, 9).cast("int") < 12))
    got = {r.unique_id: r.group_id for r in L.group_matches(blocks, ["block"], rounds_above).collect()}
    low = [(s_, x, y) for s_, x, y in model if (int(x[0][1:]) < 12) == (int(y[0][1:]) < 12)]
    assert got == L.greedy_groups([(x[0], y[0], {x[1]}, {y[1]}) for _, x, y in low])


def test_source_sets_keep_anchors_apart(spark):
    rows = [("g:1", "a", ["a", "b"], "E8", 1), ("b:2", "b", ["b"], "E8", 1), ("c:3", "c", ["c"], "E8", 1)]
    df = spark.createDataFrame(rows, "unique_id string, source string, sources array<string>, outcode string, bedrooms int")
    assert {(r.unique_id_a, r.unique_id_b) for r in L.candidate_pairs(df, ["outcode", "bedrooms"]).collect()} == {("c:3", "g:1"), ("b:2", "c:3")}


def test_dropped_photos_drop_no_more(spark):
    near = lambda h, *bits: f"{h ^ sum(1 << b for b in bits):016x}"
    h = 0x1234567890ABCDEF
    rows = [("g", 1, "u1", near(h), 1), ("g", 2, "u2", near(h, *range(8)), 1), ("g", 3, "u3", near(h, *range(20, 28)), 2), ("g", 4, "u4", None, 1), ("g", 5, "u5", near(h, *range(20, 28)), 2), ("h", 1, "u1", near(h), 1)]
    df = spark.createDataFrame(rows, "group_id string, place int, url string, phash string, priority int")
    # 1 drops 2 and falls to 3, which drops 5
    assert {(r.group_id, r.place) for r in L.perceptual_dedup(df).collect()} == {("g", 3), ("g", 4), ("h", 1)}


def test_fusion_of_golden_records(spark):
    rows = [("x", "a:1", "a", ["a", "b"], {"a": "ua", "b": "ub"}, {"a": "old a", "b": "old b"}, 10, 20, 1), ("x", "c:1", "c", ["c", "b"], {"c": "uc", "b": "other"}, {"b": "new b"}, 5, 12, 2)]
    df = spark.createDataFrame(rows, "group_id string, unique_id string, source string, sources array<string>, source_urls map<string,string>, descriptions map<string,string>, min_price int, max_price int, t int")
    df = df.withColumns({c: F.lit(None).cast(k) for c, k in {"title": "string", "bedrooms": "int", "address": "string", "postcode": "string", "latitude": "double", "longitude": "double", "floor_area_sqm": "double"}.items()}).withColumns({"price_pcm": F.lit(11), "first_seen": F.timestamp_seconds("t")})
    photos = spark.createDataFrame([("a:1", 1, "a", "p1", "gallery", "0" * 16), ("c:1", 2, "c", "p1", "gallery", "0" * 16), ("c:1", 3, "c", "p3", "gallery", "f" * 16), ("c:1", 4, "zoopla", "plan z", "floorplan", None), ("a:1", 5, "openrent", "plan o", "floorplan", None)], "unique_id string, image_id long, source string, url string, image_type string, phash string")
    g = L.fuse(df, photos).first()
    assert (g.sources, g.source_urls, g.descriptions) == (["a", "b", "c"], {"a": "ua", "b": "ub", "c": "uc"}, {"a": "old a", "b": "new b"})
    assert (g.min_price, g.max_price, g.images, g.floorplan, g.unique_id) == (5, 20, ["p1", "p3"], "plan z", "a:1")


def test_every_record_of_a_run_has_one_fate(spark, sf):
    from hearthgraph.plans import q_jobs

    out = q_jobs._run(spark, sf.replace("sf0.001", "sf0.01"))
    fates = {r.unique_id: r for r in out["fates"].collect()}
    assert len(fates) == out["fates"].count()
    kinds = {r.fate for r in fates.values()}
    assert {"rejected_criteria", "rejected_location", "seen", "unenriched", "too_far", "saved"} <= kinds
    events = defaultdict(list)
    for r in out["events"].collect():
        events[r.unique_id].append((r.stage, r.event_type))
    assert events.keys() == fates.keys()
    for u, es in events.items():
        ends = [e for _, e in es if e != "passed"]
        assert ends == ([] if fates[u].fate == "saved" else [fates[u].fate])
    assert {r.unique_id for r in out["saved"].collect()} <= {u for u, r in fates.items() if r.fate == "saved"}
    assert {r.stage: r.n for r in out["funnel"].collect()}["scraped"] == len(fates)


def test_extended_scorer_signal_by_signal(spark):
    from hearthgraph.operators import jobs as W

    texts = {"address": ("Flat 2, 10 Mare Street", "Flat 3, 10 Mare St"), "title": ("2 bed flat, balcony", "2 bed balcony flat"), "description": ("A bright flat with balcony and gas hob", "Balcony, gas hob, lift")}
    base = {"outcode": "E8", "street": "mare street", "full_postcode": None, "bedrooms": 2, "price_pcm": 1000, "latitude": None, "longitude": None}
    row = {f"{k}_{s}": v for k, v in base.items() for s in "ab"} | {f"{k}_{s}": v[i] for k, v in texts.items() for i, s in enumerate("ab")} | {"tfidf": 0.6, "embedding_similarity": 0.8, "gallery_matches": 2, "semantic_similarity": 0.5}
    kinds = {"bedrooms": "int", "price_pcm": "int", "latitude": "double", "longitude": "double", "gallery_matches": "int", "tfidf": "double", "embedding_similarity": "double", "semantic_similarity": "double"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c.removesuffix('_a').removesuffix('_b'), 'string')}" for c in row))
    got = W.match_score_ext(W.text_signals(df)).first()
    assert got.score == pytest.approx(10 + 20 + 15 + 15 * 0.6 + 25 * 0.8 + 40 * 0.85) and got.signal_count == 6 and got.is_match
    assert got.address_number == -1.0 and got.title_similarity == 1.0 and 0.75 < got.fuzzy_address < 1
    tried = W.match_score_ext(W.text_signals(df), {"address_number": 60.0, "semantic": 10.0}).first()
    assert tried.score == pytest.approx(got.score - 60) and tried.signal_count == 6 and tried.s_semantic == 0
    assert W.match_score_ext(W.text_signals(df), {"semantic": 10.0}, least={"semantic": 0.4}).first().s_semantic == pytest.approx(5)


def test_street_pairs_lose_no_extended_match(spark, sf):
    rows = L.keyed(T.listings(spark, sf)).select("unique_id", "source", "price_pcm", "bedrooms", "outcode", "street", "full_postcode", "latitude", "longitude", "phash")
    from hearthgraph.operators import jobs as W

    score = lambda p: {(r.unique_id_a, r.unique_id_b) for r in W.match_score_ext(L.with_photo(p).withColumns({"tfidf": F.lit(1.0), "embedding_similarity": F.lit(1.0)})).where("is_match").collect()}
    block = ["outcode", "bedrooms"]
    assert score(L.strong_pairs(rows, block, street=True)) == score(L.candidate_pairs(rows, block))


def test_counted_tiers_are_those_of_all_pairs(spark):
    """Source sets, equal, zero, missing and near prices, places, photos; against every pair scored."""
    rnd = random.Random(14)
    rows = []
    for i in range(240):
        sources = rnd.choice([["a"], ["b"], ["c"], ["b", "a"], ["a", "c"]])
        place = rnd.choice([(None, None), (51.5 + rnd.randint(0, 3) * 0.0005, -0.05)])
        rows.append((f"u{i:03}", sources, rnd.choice([None, 0, 1000, 1010, 1019, 1021, 1030, 1060, 1500, 1560]), rnd.choice([1, 2]), rnd.choice(["E8", None]), rnd.choice(["", None, "mare street", "well street"]), rnd.choice([None, None, "E8 3RH"]), *place, rnd.choice([None, "0" * 16, "f" * 16, "0" * 15 + "f"])))
    df = spark.createDataFrame(rows, "unique_id string, sources array<string>, price_pcm int, bedrooms int, outcode string, street string, full_postcode string, latitude double, longitude double, phash string")
    block = ["outcode", "bedrooms"]
    every = L.match_score(L.with_photo(L.candidate_pairs(df, block))).groupBy("tier").agg(F.count("*").alias("pairs"), F.max("score").alias("best"))
    want = {r.tier: (r.pairs, pytest.approx(r.best)) for r in every.collect()}
    assert {r.tier: (r.pairs, r.best) for r in L.tier_counts(df, block).collect()} == want and len(want) == 4
    assert L.tier_counts(df.limit(0), block).count() == 0


@pytest.mark.parametrize("steps", [3, 4096])
def test_order_statistics_of_any_values(spark, steps):
    from hearthgraph.operators import metrics as M

    rnd = random.Random(steps)
    for values in ([5.0], [1.0, 1.0, 2.0], [rnd.random() for _ in range(21)] + [None], [1e-300 * 10**k for k in range(0, 90, 9)] + [-1e308, 1e308], [rnd.choice([0.0, 1.0, 3.5]) for _ in range(20)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ordered = sorted(v for v in values if v is not None)
        assert M.order_statistics(df, "v", set(range(len(ordered))), steps) == dict(enumerate(ordered))
        for share in (0.0, 0.5, 0.9, 1.0):
            assert M.exact_percentile(df, "v", share, steps) == pytest.approx(df.agg(F.percentile("v", share)).first()[0])
    assert M.exact_percentile(df.limit(0), "v", 0.5) is None
