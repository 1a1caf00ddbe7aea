"""What keeps a query's memory and tasks in proportion to its tables: sizes that Spark can see, joins
that are never broadcast, rows dealt to all tasks."""

import re

from pyspark.sql import functions as F

from hearthgraph.operators import linkage as L
from hearthgraph.plans import registry
from hearthgraph.sources import testdata as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def joins(df, key):
    """Kinds of joins whose first key begins so."""
    return set(re.findall(rf"(\w+Join)\(?\w*\)? \[{key}", plan(df)))


def test_listings_are_dealt_to_all_tasks(spark, sf):
    for view in (T.listings, T.analyses, T.images):
        assert view(spark, sf).rdd.getNumPartitions() == 4  # the file gives one


def test_sizes_show_that_a_part_makes_several_listings(spark, sf):
    part = size(T.read(spark, sf, "part").select("p_partkey"))
    assert size(T.listings(spark, sf).select("item")) >= 4 * part
    assert size(T.images(spark, sf).select("image_id")) >= 16 * part


def test_entries_of_hashes_are_not_broadcast(spark, sf):
    a, b = L._sides(T.listings(spark, sf).select("unique_id", "phash"))
    assert joins(L.hamming_join(a, b, "phash_a", "phash_b"), "_block") == {"SortMergeJoin"}


def test_cells_around_are_not_broadcast(spark, sf):
    a, b = L._sides(T.listings(spark, sf).select("unique_id", "latitude", "longitude"))
    assert joins(L.proximity_join(a, b, 50.0), "_x") == {"SortMergeJoin"}


def test_equal_places_are_one_entry(spark):
    from hearthgraph.operators import joins as J

    df = spark.range(400).selectExpr("cast(id as string) unique_id", "cast(null as string) postcode", "51.5e0 latitude", "0.001e0 * (id % 2) longitude")
    ref = spark.range(400).selectExpr("concat('r', 1000 + id) label", "cast(null as string) postcode", "51.5e0 latitude", "0.001e0 * (id % 2) longitude")
    out = J.nearest_reference(df, ref, 500.0)
    assert sorted({(r.longitude, r.label) for r in out.collect()}) == [(0.0, "r1000"), (0.001, "r1001")]
    assert joins(out, "ring") == {"SortMergeJoin"}
    logical = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [unique_id" not in logical  # rows are not searched one by one


def test_counted_pairs_are_the_listed_ones(spark):
    rows = [(f"u{i * 37 % 100:02}", s, "x" if i % 3 else "y") for i, s in enumerate([["a"], ["b"], ["a", "b"], ["c"], [], ["c", "a"]] * 9)]
    rows += [("z1", ["a"], "one"), ("z2", ["a"], "one"), ("z3", ["a"], None), ("z4", ["b"], None)]
    df = spark.createDataFrame(rows, "unique_id string, sources array<string>, block string")
    listed = L.candidate_pairs(df, ["block"]).groupBy(F.col("block_a").alias("block")).agg(F.count("*").alias("pairs"), F.min("unique_id_a").alias("first_a"), F.max("unique_id_b").alias("last_b"))
    assert sorted(map(tuple, L.pair_extents(df, ["block"]).collect())) == sorted(map(tuple, listed.collect()))


def test_signals_without_weight_cost_nothing(spark, sf):
    from hearthgraph.operators import jobs as W

    assert not W.street_can_match(["address", "title"], {"address_number": 10.0})
    assert W.street_can_match(["address"], {"address_number": 25.0}) and W.street_can_match(["title"], {"title": 25.0})
    df = registry.QUERIES["match_score_ext"](spark, sf)
    assert "ArrowEvalPython" not in plan(df)  # likeness of texts, of weight 0


def test_hashes_of_a_key_meet_as_before(spark):
    """Equal hashes of two keys, hashes of one value written twice, null keys and hashes."""
    hashes = ["00000000000000ff", "00000000000000FF", "0000000000000fff", "80000000000000ff", "ff000000000000ff", None, "123"]
    rows = [(f"u{i:02}", h, k, n) for i, (h, k, n) in enumerate((h, k, n) for h in hashes for k in ("x", "y", None) for n in (1, None))]
    a, b = L._sides(spark.createDataFrame(rows, "id string, h string, k string, n int"))
    got = [tuple(r) for r in L.hamming_join(a, b, "h_a", "h_b", a_key=["k_a", "n_a"], b_key=["k_b", "n_b"]).select("id_a", "id_b", "distance").collect()]
    known = [(i, int(h, 16), k, n) for i, h, k, n in rows if h and len(h) == 16]
    near = lambda x, y: (x ^ y).bit_count()
    want = [(i, j, near(x, y)) for i, x, k, n in known for j, y, m, o in known if k and n and (k, n) == (m, o) and near(x, y) <= 8]
    assert sorted(got) == sorted(want) and {d for *_, d in want} == {0, 1, 4, 5, 7, 8}


def test_places_of_a_key_meet_only_in_it(spark):
    rows = [(f"u{i}", 51.5 + i % 3 * 1e-4, 0.0, "xy"[i % 2] if i < 8 else None) for i in range(10)]
    a, b = L._sides(spark.createDataFrame(rows, "id string, latitude double, longitude double, k string"))
    got = {(r.id_a, r.id_b) for r in L.proximity_join(a, b, 50.0, a_key=["k_a"], b_key=["k_b"]).collect()}
    every = {(r.id_a, r.id_b) for r in L.proximity_join(a, b, 50.0).where("k_a = k_b").collect()}
    assert got == every and len(got) == 32


def test_records_read_from_files_are_not_broadcast(spark, sf):
    """Files are several times smaller than the rows in them, so Spark would broadcast too much."""
    records = L.with_hashes(L.keyed(T.listings(spark, sf)), T.images(spark, sf))
    pairs = L.strong_pairs(records, ["outcode", "bedrooms"])
    assert "_explode" not in plan(pairs) and "md5" not in plan(pairs)  # records are made once
    assert "BroadcastHashJoin" not in plan(pairs)
    rows = L.grouped(T.listings(spark, sf), spark.createDataFrame([], "unique_id string, group_id string"))
    assert "BroadcastHashJoin [unique_id" not in plan(L.fuse(rows, T.images(spark, sf)))


def test_counting_tiers_makes_its_records_once(spark, sf, monkeypatch):
    kept = []
    real = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: kept.append((name, df)) or real(df, name))
    out = L.tier_counts(L.keyed(T.listings(spark, sf)).select("unique_id", "source", "price_pcm", "bedrooms", "outcode", "street", "full_postcode", "latitude", "longitude", "phash"), ["outcode", "bedrooms"])
    assert out.count() == 4 and kept[0][0] == "counted"
    made = "regexp_extract"  # as keyed() does
    assert made in plan(kept[0][1]) and not any(made in plan(df) for _, df in kept[1:])


def test_features_are_looked_for_once(spark, sf):
    assert "rlike" not in plan(registry.QUERIES["feature_overlap"](spark, sf)).lower()


def test_searched_rows_keep_their_tasks(spark, sf):
    """Spark joins tasks of a shuffle by compressed size unless a number is asked for; no side is broadcast."""
    for name in ("search_page", "map_markers", "fit_score", "recompute_stale"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert re.search(r"hashpartitioning\(unique_id#\d+, 4\), REPARTITION_BY_NUM", text), name
        assert "BroadcastHashJoin [unique_id" not in text, name
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_tasks_follow_the_parts(spark, tmp_path):
    for parts, tasks in ((10, 4), (200_000, 11)):
        spark.range(parts).selectExpr("id as p_partkey").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
        assert T.tasks(spark, str(tmp_path)) == tasks


def test_searches_share_their_rows(spark, sf):
    from hearthgraph.operators import search as Q
    from hearthgraph.plans import q_search as S

    text = plan(registry.QUERIES["search_filter"](spark, sf))
    assert text.count("from_json") <= 2 and "Union" not in text
    base = S.base(spark, sf).select("unique_id", "image_url", "has_gallery", "enrichment_status", "notification_status", "overall_rating", "analysed", "price_pcm", "bedrooms", "is_off_market", "fit_score", "has_outdoor_space")
    filters = [Q.PropertyFilter(min_price=1000, bedrooms=2), Q.PropertyFilter(min_fit=50, outdoor="no"), Q.PropertyFilter(off_market="only")]
    got = {(r.search, r.unique_id) for r in Q.search_filters(base, filters).select("search", "unique_id").collect()}
    assert got == {(i, r.unique_id) for i, f in enumerate(filters) for r in Q.search_filter(base, f).select("unique_id").collect()}


def test_streamed_keys_share_states(spark, tmp_path):
    """A call into the state for each key made a stream's time that of its keys."""
    from hearthgraph.streaming import streams as R

    spark.range(1).selectExpr("id as entity", "id as obs_id", "timestamp_seconds(id) as ts", "1 as price").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("entity long, obs_id long, ts timestamp, price int").parquet(f"{tmp_path}/in")
    assert "xxhash64(entity" in R.price_changes(stream)._jdf.queryExecution().analyzed().toString()


def test_photos_keep_their_tasks_and_are_not_broadcast(spark, sf):
    for name, key in (("image_audit", "cache_name"), ("orphan_files", "cache_name")):
        text = plan(registry.QUERIES[name](spark, sf))
        assert re.search(rf"hashpartitioning\({key}#\d+, 4\), REPARTITION_BY_NUM", text), name
        assert "BroadcastHashJoin" not in text, name


def test_galleries_are_not_broadcast(spark, sf):
    assert joins(registry.QUERIES["gallery_match_count"](spark, sf), "item") == {"SortMergeJoin"}


def test_upserting_does_not_resolve(spark, sf, monkeypatch):
    from hearthgraph.operators import jobs as W

    monkeypatch.setattr(W, "resolve_against_anchors", None)
    assert registry.QUERIES["pipeline_upsert"](spark, sf).count() > 0


def test_a_run_carries_what_decides_fates(spark, sf, monkeypatch):
    """Texts and addresses of pages of all scraped records were written and shuffled with them."""
    from hearthgraph.operators import jobs as W
    from hearthgraph.plans import q_jobs

    kept = {}
    for module in (W, L):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, real=real: kept.setdefault(name, df.columns) and real(df, name))
    out = q_jobs._run(spark, sf)
    assert not {"title", "description", "url", "image_url"} & {*kept["run"], *kept["members"], *kept["fates"]}
    assert "address" in kept["run"] and not {"address", "postcode"} & {*kept["members"], *kept["fates"]}
    assert out["fates"].count() > 0 and out["saved"].count() == out["fates"].where("fate = 'saved' and not retry").count()


def test_anchors_that_meet_no_new_record_are_left_out(spark, sf, monkeypatch):
    from hearthgraph.operators import jobs as W

    r, seen = T.listings(spark, sf), []
    real = L.qualifying_pairs
    monkeypatch.setattr(L, "qualifying_pairs", lambda df, *x: seen.append(df) or real(df, *x))
    new = r.where("k > 1 and area = 'E8' and bedrooms = 1")
    every = W.resolve_against_anchors(new, r.where("k < 2"), images=T.images(spark, sf))
    own = W.resolve_against_anchors(new, r.where("k < 2 and postcode like 'E8%' and bedrooms = 1"), images=T.images(spark, sf))
    assert {(x.postcode[:2], x.bedrooms) for x in seen[0].where("is_anchor").collect()} == {("E8", 1)}
    got, want = (sorted((tuple(map(str, x)) for x in df.collect())) for df in (every, own))
    assert got == want and any("merged_into_anchor" in x for x in got)


def test_a_run_sorts_no_queue(spark, sf, monkeypatch):
    """Anchors and retries are joined, so their order is nothing to the run."""
    from hearthgraph.operators import jobs as W
    from hearthgraph.plans import q_jobs

    plans = {}
    for module in (W, L):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, real=real: plans.setdefault(name, plan(df)) and real(df, name))
    q_jobs._run(spark, sf)
    assert "is_anchor" in plans["members"] and not any("rangepartitioning" in p for p in plans.values())


def test_rare_boilerplate_is_looked_for_at_once(spark):
    """Patterns that few texts have are one search, and what is cut is what each in turn would cut."""
    from functools import reduce

    from hearthgraph.functions import text as X

    texts = ["Property Reference: AB1. bright", "photos to folProperty reference x. low shortly. flat", "EPC: C", "the property ombudsEPC rating: Cman scheme: membership no: 5. end", "PropOmbudsmanerty", "we are proud to offer this delightful big flat. x", "Viewing highly recommended contact OpenRent today for a viewing! x", "viewing highly  recommended. Contact openrent today now. y", "a\nSUMMARY rent £1,200 b", "follow us on Instagram/x. y", "All images are for illustrative purposes only. z", "client money protection (CMP) provided by: x. y", "Whilst we use reasonable endeavours a\n\nb", "these particulars are intended to give a fair description c", "our China desk is here for you now. d", "2 weeks deposit: £5 £900 pcm available from 1/2/2025", "", None, "nothing here"]
    every = lambda c: reduce(lambda x, p: F.regexp_replace(x, p, ""), X.BOILERPLATE, c)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.clean_description(F.col("t")).alias("got"), X.collapse(every(F.coalesce("t", F.lit("")))).alias("want"))
    assert all(r.got == r.want for r in got.collect())
    assert "case when rlike" in plan(got.select("got")).lower()
    for (start, end), needed in X.RARE.items():  # each pattern has what is looked for
        words = needed.removeprefix("(?i)").split("|")
        assert all(any(w in p.lower() for w in words) for p in X.BOILERPLATE[start:end])
