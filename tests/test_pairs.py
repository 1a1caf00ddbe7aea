"""What is shuffled for pairs, and that no pair is lost or made twice."""

import random

import pytest
from pyspark.sql import functions as F

from hearthgraph.operators import linkage as L
from hearthgraph.sources.snapshots import stored

BLOCK = ["outcode", "bedrooms"]


@pytest.fixture(scope="module")
def records(spark):
    rnd = random.Random(41)
    base = [rnd.getrandbits(64) for _ in range(12)]
    near = lambda: f"{rnd.choice(base) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))):016x}"
    rows = []
    for i in range(220):
        place = rnd.choice([(None, None), (51.5 + rnd.randint(0, 40) * 0.0004, -0.05 + rnd.randint(0, 3) * 0.001)])
        photos = [near() for _ in range(rnd.choice([0, 0, 1, 2, 3]))] + ["12f"] * (i % 40 == 0)  # a hash that is too short is a number all the same
        rows.append((f"u{i:03}", rnd.choice([["a"], ["b"], ["c"], ["b", "a"]]), rnd.choice([None, 0, 1000, 1019, 1020, 1021, 1040, 1400]), 1, rnd.choice(["E8", "E8", "N1", None]), rnd.choice(["", None, "mare street", "well street"]), rnd.choice([None, None, "E8 3RH", "E8 4AA"]), *place, photos, photos[0] if photos and len(photos[0]) == 16 else None))
    df = spark.createDataFrame(rows, "unique_id string, sources array<string>, price_pcm int, bedrooms int, outcode string, street string, full_postcode string, latitude double, longitude double, hashes array<string>, phash string")
    return stored(df.withColumn("first_seen", F.lit("2025-01-01").cast("timestamp")), "records")


def ids(pairs):
    got = [(r.unique_id_a, r.unique_id_b) for r in pairs.select("unique_id_a", "unique_id_b").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("street", [False, True])
def test_pairs_come_once_and_hold_all_that_share_something(records, street):
    df = records.drop("hashes")
    every = L.match_score(L.with_photo(L.candidate_pairs(df, BLOCK)))
    shared = "s_full_postcode > 0 or gallery_matches > 0 or s_coordinates > 0" + " or s_street > 0" * street
    assert ids(every.where(shared)) <= ids(L.strong_pairs(df, BLOCK, street=street))
    few = L.match_score(L.with_photo(L.strong_pairs(df, BLOCK, street=street, price_at=L.price_needed())))
    assert ids(few.where("is_match")) == ids(every.where("is_match"))


def test_the_veto_may_come_first(records):
    df = records.withColumn("photos", F.transform("hashes", L.hash_long))
    scored = lambda p: L.gallery_veto(L.match_score(p.withColumn("gallery_matches", L.photo_matches(F.col("photos_a"), F.col("photos_b")))))
    every, few = scored(L.candidate_pairs(df, BLOCK)), L.strong_pairs(df.drop("hashes"), BLOCK, price_at=L.price_needed(), vetoed=True)
    assert ids(scored(few)) == ids(every) and len(ids(every)) > 50
    shown = F.size("photos_a") * F.size("photos_b") > 0
    assert few.where(shown & (L.photo_matches(F.col("photos_a"), F.col("photos_b")) == 0)).isEmpty()


def test_flips_are_made_where_they_meet(spark, records):
    """67 entries of a hash were shuffled for each side of the join."""
    a, b = L._sides(records.select("unique_id", "phash"))
    out = L.hamming_join(a, b, "phash_a", "phash_b", tasks=5)
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(_block" not in text and "ReusedExchange" in text
    assert "hashpartitioning(_part" in text and ", 5)" in text


def test_pairs_of_a_postcode_are_not_shuffled(spark, records):
    """Ids of pairs were made distinct and joined with the columns of both sides."""
    out = L.strong_pairs(records.drop("hashes", "phash"), BLOCK)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(unique_id_a" not in text and "hashpartitioning(unique_id_b" not in text


def test_places_around_meet_once(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([-33.9, 51.5, 0.0]) + rnd.uniform(-0.003, 0.003), rnd.uniform(-0.003, 0.003)) for i in range(200)] + [(200, None, 0.0)]
    a, b = L._sides(spark.createDataFrame(rows, "i int, latitude double, longitude double"))
    every = a.crossJoin(b).withColumn("m", L.G.haversine_m(*(F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")))).where("m <= 100")
    got = [(r.i_a, r.i_b) for r in L.proximity_join(a, b, 100.0).collect()]
    assert sorted(got) == sorted((r.i_a, r.i_b) for r in every.collect()) and len(got) > 400
    assert "sequence(" in L.proximity_join(a, b, 100.0)._jdf.queryExecution().executedPlan().toString()


def test_few_rows_of_a_hash_are_dealt(spark, records):
    """Small keys need few first bits: 9 rows of a hash at two bits; results do not depend on them."""
    a, b = L._sides(records.select("unique_id", "phash"))
    got = [sorted(map(tuple, L.hamming_join(a, b, "phash_a", "phash_b", bits=bits).select("unique_id_a", "unique_id_b", "distance").collect())) for bits in (1, 2, 6, 10)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) > 300
    pairs = L.strong_pairs(records.drop("hashes"), BLOCK)
    assert "sequence(0, 8," in pairs._jdf.queryExecution().analyzed().toString()


def test_matchers_are_evaluated_in_one_count(spark):
    """Labelled pairs were stored, and read for each of metrics, signals and sweep of each scorer."""
    from hearthgraph.operators import jobs as W
    from hearthgraph.operators import metrics as M

    rnd = random.Random(3)
    rows = [(f"p{i}", rnd.choice([0.0, 19.99996, 20.0, 39.99, 60.00001, 130.0, 5.0]), rnd.random() < 0.5, rnd.choice([0.0, 20.0]), rnd.choice(["match", "no_match", "uncertain"])) for i in range(300)]
    pairs = spark.createDataFrame(rows, "pair_id string, score double, is_match boolean, s_street double, label string")
    got = W.evaluate_matcher(pairs.drop("label"), pairs.select("pair_id", "label").union(spark.createDataFrame([("q", "match")], "pair_id string, label string")), ["street"], 0, 120, 20)
    known = pairs.where("label <> 'uncertain'").withColumns({"truth": F.col("label") == "match", "score": F.round("score", 4)})
    truth, seen = F.col("truth"), lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    assert seen(got["metrics"]) == seen(M.confusion(known, F.col("is_match"), truth))
    assert seen(got["signals"]) == seen(M.signal_firing(known, ["s_street"], F.col("is_match"), truth))
    assert seen(got["sweep"]) == seen(M.threshold_sweep(known, truth, 0, 120, 20))
    assert seen(got["errors"]) == seen(M.errors(known, F.col("is_match"), truth).select("pair_id", "score", "kind"))
    assert [r.pair_id for r in got["missing"].collect()] == ["q"]
    assert M.tally(known, {"t": truth}, {"score": F.col("score")}, 0, 120, 20).count() <= 2 * 5


def test_evaluating_stores_no_pairs(spark, sf, monkeypatch):
    from hearthgraph.operators import jobs as W
    from hearthgraph.plans import registry

    kept = {}
    for module in (W, L):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, real=real: kept.setdefault(name, df.columns) and real(df, name))
    registry.QUERIES["evaluate_matcher"](spark, sf)
    assert not any({"unique_id_a", "pair_id"} & {*columns} for columns in kept.values()) and "tally" in kept
