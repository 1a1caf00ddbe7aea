"""Galleries in resolution: what they add to the score, and what they veto."""

import random

import pytest
from pyspark.sql import functions as F

from hearthgraph.operators import jobs as W
from hearthgraph.operators import linkage as L

LISTING = "unique_id string, source string, url string, title string, price_pcm int, bedrooms int, address string, postcode string, latitude double, longitude double, first_seen timestamp, phash string, floor_area_sqm double"
IMAGE = "unique_id string, image_id long, image_type string, phash string, source string, url string"
RND = random.Random(5)
P = [f"{RND.getrandbits(64):016x}" for _ in range(12)]  # no two of them near


def flip(h):
    return f"{int(h, 16) ^ 0b1011:016x}"


#: unique_id -> price, address, postcode, main photo, gallery
HOMES = {
    "a:1": (1500, "1 Mare Street", "E8", P[0], [P[1], P[2], P[3]]),  # two photos alike, not the main one; no place
    "b:1": (1900, "1 Mare Street", "E8", P[4], [flip(P[2]), flip(P[3])]),
    "a:2": (1500, "2 Well Street", "E9 5AA", P[5], [P[5], P[6]]),  # flats of one building, none alike
    "b:2": (1500, "2 Well Street", "E9 5AA", P[7], [P[7], P[8]]),
    "a:3": (1500, "3 Roman Road", "E3 5AA", None, []),  # one side has no photo
    "b:3": (1500, "3 Roman Road", "E3 5AA", P[9], [P[9]]),
    "a:4": (1500, "4 High Street", "N1 5AA", P[10], []),  # main photos in place of galleries
    "b:4": (1500, "4 High Street", "N1 5AA", P[11], []),
}


@pytest.fixture(scope="module")
def homes(spark):
    rows = [(u, u[0], f"https://{u}", "x", p, 1, a, c, None, None, None, h, None) for u, (p, a, c, h, _) in HOMES.items()]
    df = spark.createDataFrame(rows, LISTING).withColumn("first_seen", F.lit("2025-01-01").cast("timestamp"))
    photos = [(u, i, "gallery", h, u[0], f"{u}-{i}") for u, v in HOMES.items() for i, h in enumerate(v[4])]
    return df, spark.createDataFrame([*photos, ("a:3", 9, "floorplan", P[0], "a", "plan"), ("a:3", 10, "gallery", None, "a", "x")], IMAGE)


def test_shared_photos_merge_and_strange_ones_part(homes):
    df, images = homes
    assert {r.group_id: r.members for r in L.resolve_entities(df, images=images).collect()} == {"a:1": 2, "a:2": 1, "b:2": 1, "a:3": 2, "a:4": 1, "b:4": 1}
    assert {(r.absorbed, r.kept) for r in W.resolve_existing(df, images)["absorbed"].collect()} == {("b:1", "a:1"), ("b:3", "a:3")}
    left = W.resolve_existing(df, images, {"images": (images, "unique_id")})["images"]
    assert {r.unique_id for r in left.collect()} == {"a:1", "a:2", "a:3", "b:2"}
    fates = W.resolve_against_anchors(df.where("source = 'b'"), df.where("source = 'a'"), images=images).collect()
    assert {r.unique_id: r.anchor_id for r in fates} == {"b:1": "a:1", "b:2": None, "b:3": "a:3", "b:4": None}


def test_two_alike_give_forty(homes):
    df, images = homes
    got = {r.unique_id_a: (r.s_image_hash, r.score) for r in L.qualifying_pairs(df, ["outcode", "bedrooms"], images).collect()}
    assert got == {"a:1": (40.0, 70.0), "a:3": (0.0, 85.0)}


def test_galleries_against_all_pairs(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(8)]
    photo = lambda: f"{rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))):016x}"
    rows = [(f"{s}:{i}", s, rnd.choice([1000, 1010, 1500]), 1, "E8", rnd.choice(["mare street", "well street"]), rnd.choice([None, "E8 3RH", "E8 1AA"]), None, None, [photo() for _ in range(rnd.randint(1, 3))] if rnd.random() < 0.8 else None) for s in "abc" for i in range(25)]
    df = spark.createDataFrame(rows, "unique_id string, source string, price_pcm int, bedrooms int, outcode string, street string, full_postcode string, latitude double, longitude double, hashes array<string>")

    def model(x, y):
        used = set()
        for h in x[9] or []:
            free = [j for j, g in enumerate(y[9] or []) if j not in used and (int(h, 16) ^ int(g, 16)).bit_count() <= 8]
            used |= {min(free)} if free else set()
        pct = abs(x[2] - y[2]) / ((x[2] + y[2]) / 2)
        price = 1 if pct == 0 else 1 - 0.5 * pct / 0.03 if pct <= 0.03 else 0
        score = 20 * min(2, len(used)) + 40 * (x[6] == y[6] and x[6] is not None) + 20 * (x[5] == y[5]) + 10 + 15 * price
        return score >= 60 and not (x[9] and y[9] and not used)

    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1] and model(x, y)}
    pairs = L.strong_pairs(df, ["outcode", "bedrooms"]).withColumn("gallery_matches", L.gallery_match_count(F.col("hashes_a"), F.col("hashes_b")))
    assert {(r.unique_id_a, r.unique_id_b) for r in L.gallery_veto(L.match_score(pairs)).collect()} == want and want


def test_look_alikes_against_a_model(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(3)]
    rows = [(f"g{g}", i, f"u{i}", None if rnd.random() < 0.1 else f"{rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))):016x}", rnd.randint(1, 3)) for g in range(30) for i in range(rnd.randint(1, 12))]

    def model(group):
        stays = [True] * len(group)
        for i, x in enumerate(group):
            for j in range(i + 1, len(group)):
                y = group[j]
                if stays[i] and stays[j] and x[3] and y[3] and (int(x[3], 16) ^ int(y[3], 16)).bit_count() <= 8:
                    stays[i if y[4] > x[4] else j] = False
        return {x[:2] for x, s in zip(group, stays) if s}

    want = set().union(*(model([r for r in rows if r[0] == f"g{g}"]) for g in range(30)))
    df = spark.createDataFrame(rows, "group_id string, place int, url string, phash string, priority int")
    got = L.perceptual_dedup(df)
    assert {(r.group_id, r.place) for r in got.collect()} == want and got.columns == df.columns


def test_photos_as_longs_count_as_hex_does(spark):
    rnd = random.Random(3)
    near = lambda h: f"{h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 10))):016x}"
    base = [rnd.getrandbits(64) for _ in range(3)]
    rows = [([near(rnd.choice(base)) for _ in range(rnd.randint(0, 5))] or None, [near(rnd.choice(base)) for _ in range(rnd.randint(0, 5))]) for _ in range(120)]

    def model(a, b):
        left = list(b)
        for x in a or []:
            hit = next((y for y in left if (int(x, 16) ^ int(y, 16)).bit_count() <= 8), None)
            if hit is not None:
                left.remove(hit)
        return len(b) - len(left) if a and b else 0

    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", L.gallery_match_count(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == model(r.a, r.b) for r in got.collect())
