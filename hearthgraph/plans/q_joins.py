"""Joins, aggregates and histories with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgraph.operators import aggregates as G
from hearthgraph.operators import history as H
from hearthgraph.operators import joins as J
from hearthgraph.plans.registry import query
from hearthgraph.sources import testdata as T


@query("SELECT l.unique_id, a.overall_rating, a.fit_score FROM listings l LEFT JOIN analyses a ON l.unique_id = a.unique_id")
def listing_with_analysis(spark, sf):
    return J.listing_with_analysis(T.listings(spark, sf), T.analyses(spark, sf)).select("unique_id", "overall_rating", "fit_score")


@query("SELECT unique_id, COALESCE(merged_id, CASE WHEN item % 4 > 0 THEN 'G' || CAST(item AS VARCHAR) END) AS merged_id FROM listings")
def link_by_url(spark, sf):
    r = T.listings(spark, sf)
    golden = r.where("item % 4 > 0").groupBy(F.concat(F.lit("G"), F.col("item").cast("string")).alias("golden_id")).agg(F.map_from_entries(F.collect_list(F.struct("source", "url"))).alias("source_urls"))
    return J.link_by_url(r, golden).select("unique_id", "merged_id")


@query("SELECT unique_id, CASE WHEN item % 3 = 0 THEN 'new' ELSE merged_id END AS merged_id FROM listings")
def apply_links(spark, sf):
    r = T.listings(spark, sf)
    return J.apply_links(r, r.where("item % 3 = 0").select("unique_id", F.lit("new").alias("merged_id"))).select("unique_id", "merged_id")


@query("""SELECT unique_id, COALESCE(w, CASE WHEN greatest(p0, p1) = 0 THEN NULL WHEN p0 >= p1 THEN area || ' north' ELSE area || ' south' END) AS micro_area FROM (SELECT unique_id, area, CASE WHEN item % 5 = 1 AND item % 2 = 0 THEN area || ' north' END AS w,
 CASE WHEN lower(address) LIKE '%small%' THEN 10 ELSE 3 * (CAST(lower(address) LIKE '%red%' AS INT) + CAST(lower(address) LIKE '%part%' AS INT)) END + 5 * CAST(lower(address) LIKE '%flat 1%' AS INT) AS p0, CASE WHEN lower(address) LIKE '%large%' THEN 10 ELSE 3 * CAST(lower(address) LIKE '%blue%' AS INT) END + 5 * CAST(lower(address) LIKE '% st,%' AS INT) AS p1 FROM listings)""")
def micro_areas(spark, sf):
    r = T.listings(spark, sf).select("unique_id", F.col("area").alias("outcode"), "address", F.concat(F.lit("ward"), (F.col("item") % 5).cast("string"), (F.col("item") % 2).cast("string")).alias("ward"))
    outs = T.listings(spark, sf).select(F.col("area").alias("outcode")).distinct()
    lit = lambda *x: F.array(*map(F.lit, x))
    north = outs.select("outcode", F.lit(0).alias("pos"), F.concat("outcode", F.lit(" north")).alias("name"), lit("small").alias("phrases"), lit("red", "part").alias("words"), lit("flat 1").alias("streets"))
    south = outs.select("outcode", F.lit(1).alias("pos"), F.concat("outcode", F.lit(" south")).alias("name"), lit("large").alias("phrases"), lit("blue").alias("words"), lit(" st,").alias("streets"))
    wards = outs.select("outcode", F.lit("ward10").alias("ward"), F.concat("outcode", F.lit(" north")).alias("name")).union(outs.select("outcode", F.lit("ward20"), F.lit("nowhere")))
    return J.micro_area_lookup(r, wards, north.union(south)).select("unique_id", "micro_area")


_REF = "SELECT 'p' || CAST(p_partkey AS VARCHAR) AS label, 51.5 + (p_partkey % 97) * 0.003 AS la, -0.05 + (p_partkey % 89) * 0.003 AS lo FROM part WHERE p_partkey % 3 = 0"
_RH = "pow(sin((radians(la) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(la)) * pow(sin(radians(lo - longitude) / 2), 2)"


@query(f"SELECT unique_id, round(min(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))), 2) AS metres FROM (SELECT l.unique_id, {_RH} AS h FROM (SELECT * FROM listings WHERE latitude IS NOT NULL) l, ({_REF}) r) GROUP BY 1")
def nearest_reference(spark, sf):
    from hearthgraph.functions.geo import haversine_m

    ref = T.parts(spark, sf).where("p_partkey % 3 = 0").selectExpr("'p' || p_partkey as label", "51.5 + (p_partkey % 97) * 0.003 as latitude", "-0.05 + (p_partkey % 89) * 0.003 as longitude", "cast(null as string) as postcode")
    rows = T.listings(spark, sf).where("latitude is not null").select("unique_id", "postcode", "latitude", "longitude")
    out = J.nearest_reference(rows, ref, 500.0).join(ref.select("label", F.col("latitude").alias("la"), F.col("longitude").alias("lo")), "label")
    return out.select("unique_id", F.round(haversine_m(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo")), 2).alias("metres"))


_REF_ALL = f"SELECT 'p' || CAST(p_partkey AS VARCHAR) AS label, CASE WHEN p_partkey % 4 > 0 THEN 51.5 + (p_partkey % 97) * 0.003 END AS la, CASE WHEN p_partkey % 4 > 0 THEN -0.05 + (p_partkey % 89) * 0.003 END AS lo, {T._FULL} AS postcode FROM part WHERE p_partkey % 3 = 0"


@query(f"""SELECT l.unique_id, round(d.metres, 2) AS metres, CASE WHEN d.metres IS NULL THEN c.label END AS by_code FROM listings l LEFT JOIN (SELECT unique_id, min(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))) AS metres FROM (SELECT x.unique_id, {_RH} AS h FROM (SELECT * FROM listings WHERE latitude IS NOT NULL) x, (SELECT * FROM ref WHERE la IS NOT NULL) r) GROUP BY 1) d ON l.unique_id = d.unique_id
 LEFT JOIN (SELECT postcode, min(label) AS label FROM ref GROUP BY 1) c ON l.postcode = c.postcode""", ref=_REF_ALL)
def nearest_reference_all(spark, sf):
    """Every listing: those with a place by distance, the others by postcode."""
    from hearthgraph.functions.geo import haversine_m

    ref = T.parts(spark, sf).where("p_partkey % 3 = 0").selectExpr("'p' || p_partkey as label", "case when p_partkey % 4 > 0 then 51.5 + (p_partkey % 97) * 0.003 end as latitude", "case when p_partkey % 4 > 0 then -0.05 + (p_partkey % 89) * 0.003 end as longitude", f"{T._FULL} as postcode")
    out = J.nearest_reference(T.listings(spark, sf).select("unique_id", "postcode", "latitude", "longitude"), ref, 500.0).join(ref.select("label", F.col("latitude").alias("la"), F.col("longitude").alias("lo")), "label", "left")
    return out.select("unique_id", F.round(haversine_m(F.col("latitude"), F.col("longitude"), F.col("la"), F.col("lo")), 2).alias("metres"), F.when(F.col("latitude").isNull(), F.col("label")).alias("by_code"))


@query("SELECT unique_id, round(COALESCE(latitude, CASE WHEN postcode LIKE '% %' THEN 51.0 END), 6)::DOUBLE AS latitude FROM listings")
def geocode(spark, sf):
    r = T.listings(spark, sf)
    coords = r.where("postcode like '% %'").select("postcode", F.lit(51.0).alias("latitude"), F.lit(0.5).alias("longitude"))
    return J.geocode(r, coords).select("unique_id", F.round("latitude", 6).alias("latitude"))


@query("SELECT unique_id, CASE WHEN item % 2 = 0 AND (postcode IS NULL OR postcode NOT LIKE '% %') THEN 'E1 1AA' ELSE postcode END AS postcode, round(CASE WHEN item % 2 = 0 THEN COALESCE(latitude, 50.0) ELSE latitude END, 6)::DOUBLE AS latitude FROM listings")
def cached_backfill(spark, sf):
    r = T.listings(spark, sf)
    kept = r.where("item % 2 = 0").select("unique_id", F.lit("E1 1AA").alias("postcode"), F.lit(50.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    return J.cached_backfill(r, kept).select("unique_id", "postcode", F.round("latitude", 6).alias("latitude"))


@query("SELECT merged_id AS golden_id, string_agg(unique_id, ',' ORDER BY source) AS ids FROM listings WHERE merged_id IS NOT NULL GROUP BY 1 HAVING bool_or(source = 'zoopla')")
def golden_with_listings(spark, sf):
    r = T.listings(spark, sf).where("merged_id is not null")
    golden = r.groupBy(F.col("merged_id").alias("golden_id")).agg(F.min_by("source", "k").alias("source"), F.map_from_entries(F.collect_list(F.struct("source", "url"))).alias("source_urls"))
    return J.golden_with_listings(golden, r, "zoopla").select("golden_id", F.array_join(F.transform("listings", lambda x: x["unique_id"]), ",").alias("ids"))


@query("""SELECT item AS golden_id, string_agg(CASE WHEN k <> 1 THEN source || '-a,' || source || '-b' END, ',' ORDER BY k) AS gallery, min_by(source, k) FILTER (k >= 2) AS floorplan, min_by(floor_area_sqm, k) FILTER (k <> 1 AND floor_area_sqm IS NOT NULL) AS floor_area,
 COALESCE(min_by(postcode, k) FILTER (k <> 1 AND postcode IS NOT NULL), 'E8') AS postcode FROM listings GROUP BY item""")
def enrich_from_details(spark, sf):
    r = T.listings(spark, sf)
    golden = r.groupBy(F.col("item").alias("golden_id")).agg(F.array_sort(F.collect_list(F.struct("k", "source")))["source"].alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "url"))).alias("source_urls"))
    golden = golden.withColumns({"postcode": F.lit("E8"), "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    details = r.where("k <> 1").select("url", F.array(F.concat("source", F.lit("-a")), F.concat("source", F.lit("-b"))).alias("gallery"), F.when(F.col("k") >= 2, F.col("source")).alias("floorplan"), F.col("floor_area_sqm").alias("floor_area"), "postcode", "latitude", "longitude")
    out = J.enrich_from_details(golden, details)
    return out.select("golden_id", F.array_join("gallery", ",").alias("gallery"), "floorplan", "floor_area", "postcode")


@query("SELECT l.unique_id, COALESCE(g.h, l.phash) AS hashes FROM listings l LEFT JOIN (SELECT unique_id, string_agg(phash, ',' ORDER BY image_id) AS h FROM images WHERE image_type = 'gallery' GROUP BY 1) g ON l.unique_id = g.unique_id JOIN (SELECT area, price_pcm FROM listings GROUP BY 1, 2 HAVING count(*) > 1) b ON l.area = b.area AND l.price_pcm = b.price_pcm")
def image_hash_set(spark, sf):
    return J.image_hash_set(T.listings(spark, sf), T.images(spark, sf), ["area", "price_pcm"]).select("unique_id", F.array_join("hashes", ",").alias("hashes"))


@query("SELECT CASE WHEN p.id IS NULL THEN 'unmatched' ELSE l.label END AS label, count(*) AS n FROM (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'uncertain' WHEN quality = 1 THEN 'match' ELSE 'no_match' END AS label FROM labels) l LEFT JOIN (SELECT doc_id AS id FROM documents WHERE n_chars > 800) p ON l.id = p.id WHERE label <> 'uncertain' GROUP BY 1")
def labels_join(spark, sf):
    labels = T.read(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), F.when(F.col("doc_id") % 7 == 0, "uncertain").when(F.col("quality") == 1, "match").otherwise("no_match").alias("label"))
    pairs = T.read(spark, sf, "documents").where("n_chars > 800").select(F.col("doc_id").alias("pair_id"))
    hit, missed = J.labels_join(labels, pairs)
    return hit.select("label").union(missed.select(F.lit("unmatched"))).groupBy("label").agg(F.count("*").alias("n"))


_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 1)"
_GRAMS = "unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS t"


@query("SELECT p.id_a, p.id_b, CASE WHEN p.n < 20 THEN 0 WHEN lower(p.ca) = lower(p.cb) THEN 1 ELSE COALESCE(round(d.dot / (x.norm * y.norm), 6), 0) END AS similarity FROM pairs p LEFT JOIN norms x ON p.id_a = x.id_a AND x.s = 0 LEFT JOIN norms y ON p.id_a = y.id_a AND y.s = 1 LEFT JOIN dots d ON p.id_a = d.id_a",
 words=f"SELECT doc_id AS id, {_SPLIT.format('text')} AS w FROM documents",
 grams=f"SELECT id, {_GRAMS} FROM words",
 tf="SELECT id, t, count(*) AS tf FROM grams GROUP BY 1, 2",
 idf="SELECT t, ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + df)) + 1 AS idf FROM (SELECT t, count(*) AS df, sum(tf) AS n FROM tf GROUP BY 1 ORDER BY n DESC, t LIMIT 5000)",
 pairs="SELECT id_a, id_b, n, substr(ta, 1, n) AS ca, substr(tb, 1, n) AS cb FROM (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.text AS ta, b.text AS tb, COALESCE(least(length(a.text), length(b.text)), 0) AS n FROM documents a JOIN documents b ON a.doc_id + 1 = b.doc_id)",
 sides=f"SELECT id_a, 0 AS s, {_SPLIT.format('ca')} AS w FROM pairs UNION ALL SELECT id_a, 1, {_SPLIT.format('cb')} FROM pairs",
 weights=f"SELECT id_a, s, g.t, count(*) * any_value(idf) AS w FROM (SELECT id_a, s, {_GRAMS} FROM sides) g JOIN idf ON g.t = idf.t GROUP BY 1, 2, 3",
 norms="SELECT id_a, s, sqrt(sum(w * w)) AS norm FROM weights GROUP BY 1, 2",
 dots="SELECT a.id_a, sum(a.w * b.w) AS dot FROM weights a JOIN weights b ON a.id_a = b.id_a AND a.t = b.t AND a.s = 0 AND b.s = 1 GROUP BY 1")
def tfidf_cosine(spark, sf):
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ids = docs.select("id")
    pairs = ids.join(ids.select((F.col("id") - 1).alias("id")), "id").select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    return J.tfidf_cosine(docs, pairs).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query("SELECT entity, obs_id, old AS old_price, price AS new_price, price - old AS change FROM (SELECT *, lag(price) OVER (PARTITION BY entity ORDER BY ts, obs_id) AS old FROM obs) WHERE old <> price")
def price_changes(spark, sf):
    return H.price_changes(T.observations(spark, sf)).select("entity", "obs_id", "old_price", "new_price", "change")


_CH = "SELECT *, price - old AS change FROM (SELECT *, lag(price) OVER (PARTITION BY entity ORDER BY ts, obs_id) AS old FROM obs) WHERE old <> price"


@query(f"SELECT entity, change AS last_change, floor(epoch(ts))::BIGINT AS changed_at FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, obs_id DESC) AS n FROM ({_CH})) WHERE n = 1")
def latest_change(spark, sf):
    return H.latest_change(H.price_changes(T.observations(spark, sf))).select("entity", "last_change", F.unix_timestamp("changed_at").alias("changed_at"))


@query(f"SELECT entity, change FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, obs_id DESC) AS n FROM ({_CH}) WHERE change < 0 AND entity % 7 IN (0, 3, 6)) WHERE n = 1 AND entity % 2 = 0")
def latest_unsent_drop(spark, sf):
    parts = T.parts(spark, sf).selectExpr("p_partkey as entity", "case when p_partkey % 7 in (0, 3, 6) then 'sent' else 'pending' end as notification_status", "p_partkey % 2 > 0 as told")
    return H.latest_unsent_drop(H.price_changes(T.observations(spark, sf)), parts).select("entity", "change")


@query("SELECT first_img.unique_id, url FROM (SELECT unique_id, url, row_number() OVER (PARTITION BY unique_id ORDER BY image_id) AS n FROM images WHERE image_type = 'gallery' AND NOT regexp_matches(lower(url), 'epc|energy-performance|energy_performance')) first_img WHERE n = 1")
def first_gallery_image(spark, sf):
    from hearthgraph.operators.filters import with_flags

    im = with_flags(T.images(spark, sf)).where("image_type = 'gallery' and not epc")
    return im.groupBy("unique_id").agg(F.min_by("url", "image_id").alias("url"))


_EV = "SELECT *, event_type = 'error' AS f, sum(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"


@query(f"""SELECT event_id, streak, COALESCE(max(CAST(streak >= 2 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS skipped
 FROM (SELECT *, CASE WHEN f THEN CAST(sum(CAST(f AS INT)) OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS BIGINT) ELSE 0 END AS streak FROM ({_EV}))""")
def consecutive_failures(spark, sf):
    e = T.read(spark, sf, "events")
    return H.consecutive_failures(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "streak", "skipped")


@query("SELECT event_id, event_type AS to_status, lag(event_type, 1, 'new') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status FROM events")
def status_transitions(spark, sf):
    return H.status_transitions(T.read(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "to_status", "from_status")


@query("""SELECT user_id, floor(epoch(ts))::BIGINT AS off_at, floor(epoch(back))::BIGINT AS back_at, event_type AS reason FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM
 (SELECT *, event_type IN ('error', 'signup') AS o, lag(event_type IN ('error', 'signup'), 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM events) WHERE o <> w) WHERE o""")
def off_market_intervals(spark, sf):
    e = T.read(spark, sf, "events")
    out = H.off_market_intervals(e, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "signup"), "event_type", "ts")
    return out.select("user_id", F.unix_timestamp("off_at").alias("off_at"), F.unix_timestamp("back_at").alias("back_at"), "reason")


_PG = "SELECT l_orderkey, l_suppkey % 4 AS src, l_orderkey // 40 AS page, l_partkey % 3 < 2 AS known, (l_orderkey // 40) % 11 = 5 AS failed FROM lineitem"


_RUNS = "SELECT o_custkey AS run_id, min(o_orderdate) AS a, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE max(o_orderdate) END AS b FROM orders GROUP BY 1"


def _runs(spark, sf):
    o = T.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("completed_at"))
    return o.withColumn("completed_at", F.when(F.col("run_id") % 5 > 0, F.col("completed_at")))


@query(f"SELECT run_id, (epoch(b) - epoch(a))::BIGINT AS seconds, run_id = (SELECT run_id FROM ({_RUNS}) WHERE b IS NOT NULL ORDER BY a DESC, run_id DESC LIMIT 1) AS is_last FROM ({_RUNS})")
def run_duration(spark, sf):
    runs = _runs(spark, sf)
    last = H.last_run(runs).select(F.col("run_id").alias("last"))
    return H.run_durations(runs).crossJoin(F.broadcast(last)).select("run_id", "seconds", (F.col("run_id") == F.col("last")).alias("is_last"))


@query("SELECT item, unique_id FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY first_seen, unique_id) AS n FROM listings) WHERE n = 1")
def dedupe_by_id(spark, sf):
    return G.first_rows(T.listings(spark, sf), ["item"], ["first_seen", "unique_id"]).select("item", "unique_id")


@query("SELECT source, item, area FROM (SELECT source, item % 37 AS item, area, row_number() OVER (PARTITION BY source, item % 37 ORDER BY area, item) AS n FROM listings) WHERE n = 1")
def dedupe_across_pages(spark, sf):
    r = T.listings(spark, sf).withColumns({"page": F.col("item"), "item": F.col("item") % 37})
    return G.first_rows(r, ["source", "item"], ["area", "page"]).select("source", "item", "area")


@query("SELECT source, count(*) AS n, CAST(sum(CASE WHEN attempts < 3 THEN 1 ELSE 0 END) AS BIGINT) AS backlog, count(DISTINCT source_id) AS ids FROM listings GROUP BY 1")
def source_counts(spark, sf):
    return T.listings(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("attempts") < 3, 1).otherwise(0)).alias("backlog"), F.countDistinct("source_id").alias("ids"))


@query("SELECT attempts, count(*) AS n FROM listings WHERE attempts < 3 GROUP BY 1")
def retry_backlog(spark, sf):
    return T.listings(spark, sf).where("attempts < 3").groupBy("attempts").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source, source_id FROM listings")
def known_ids(spark, sf):
    return T.listings(spark, sf).select("source", "source_id").distinct()


@query("SELECT unique_id, source AS sources, url AS own_url, price_pcm AS min_price FROM listings")
def wrap_single(spark, sf):
    w = G.wrap_single(T.listings(spark, sf))
    return w.select("unique_id", F.array_join("sources", ",").alias("sources"), F.element_at("source_urls", F.element_at("sources", 1)).alias("own_url"), "min_price")


@query("SELECT item, max_by(source, CASE source WHEN 'zoopla' THEN 4 WHEN 'rightmove' THEN 3 WHEN 'onthemarket' THEN 2 ELSE 1 END) AS best, max_by(description, length(description) * 10 - k) AS longest FROM listings GROUP BY 1")
def best_by_priority(spark, sf):
    p = F.when(F.col("source") == "zoopla", 4).when(F.col("source") == "rightmove", 3).when(F.col("source") == "onthemarket", 2).otherwise(1)
    return T.listings(spark, sf).groupBy("item").agg(G.best_by_priority(F.col("source"), p, F.col("k")).alias("best"), G.longest_text(F.col("description"), F.col("k")).alias("longest"))


@query("SELECT item AS id, min(m) AS minutes, min_by(mode, m * 10 + length(mode)) AS mode FROM (SELECT item, (item * (k + 3)) % 60 AS m, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'bb' WHEN 2 THEN 'ccc' ELSE 'dddd' END AS mode FROM listings) WHERE m <= 30 GROUP BY 1")
def best_commute(spark, sf):
    times = T.listings(spark, sf).selectExpr("item as id", "(item * (k + 3)) % 60 as minutes", "case k when 0 then 'a' when 1 then 'bb' when 2 then 'ccc' else 'dddd' end as mode")
    return G.best_commute(times, 30)


_TIMES = "SELECT item AS id, (item * (k + 3)) % 60 AS m, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'bb' WHEN 2 THEN 'ccc' ELSE 'dddd' END AS mode FROM listings"


@query(f"""SELECT mode, count(*) AS tried, count(*) FILTER (m <= 30) AS within, count(*) FILTER (m <= 30 AND n = 1) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, mode) AS n FROM ({_TIMES})) GROUP BY 1
 UNION ALL SELECT 'all', count(DISTINCT id), count(DISTINCT id) FILTER (m <= 30), count(DISTINCT id) FILTER (m <= 30) FROM ({_TIMES})""")
def commute_summary(spark, sf):
    times = T.listings(spark, sf).selectExpr("item as id", "(item * (k + 3)) % 60 as minutes", "case k when 0 then 'a' when 1 then 'bb' when 2 then 'ccc' else 'dddd' end as mode")
    return G.commute_summary(times, 30)


_CHECK = "SELECT item AS id, k AS pos, source, CASE (item * 3 + k * (item % 4)) % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'removed' WHEN 2 THEN 'let_agreed' ELSE 'unknown' END AS status, item % 3 = 0 AS was_off FROM listings"


def _checks(spark, sf):
    return T.listings(spark, sf).selectExpr("item as id", "k as pos", "source", "case cast((item * 3 + k * (item % 4)) % 4 as int) when 0 then 'active' when 1 then 'removed' when 2 then 'let_agreed' else 'unknown' end as status", "item % 3 = 0 as was_off")


@query(f"SELECT id, g AND NOT w AS off, a AND w AS returned, CASE WHEN g THEN r END AS reason FROM (SELECT id, bool_and(status IN ('removed', 'let_agreed')) AS g, bool_or(status = 'active') AS a, bool_or(was_off) AS w, min_by(status, pos) FILTER (status IN ('removed', 'let_agreed')) AS r FROM ({_CHECK}) GROUP BY 1)")
def derive_off_market(spark, sf):
    return G.derive_off_market(_checks(spark, sf))


@query(f"SELECT source, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'let_agreed') AS let_agreed, count(*) FILTER (status = 'unknown') AS unknown FROM ({_CHECK}) GROUP BY 1")
def check_breakdown(spark, sf):
    return _checks(spark, sf).groupBy("source").pivot("status", ["active", "removed", "let_agreed", "unknown"]).count().fillna(0)


_DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS run_id, " + ", ".join(f"count(DISTINCT user_id) FILTER (event_type = '{x}') AS {x}, (epoch_us(max(ts) FILTER (event_type = '{x}')) - epoch_us(min(ts) FILTER (event_type = '{x}'))) / 1e6 AS {x}_seconds" for x in ("view", "click", "purchase")) + " FROM events GROUP BY 1"


@query(f"SELECT run_id, view, click, purchase, CASE WHEN view = 0 THEN 0 ELSE round(click::DOUBLE / view, 6) END AS click_share, CASE WHEN click = 0 THEN 0 ELSE round(purchase::DOUBLE / click, 6) END AS purchase_share, round(view_seconds, 3) AS view_seconds, round(click_seconds, 3) AS click_seconds, round(purchase_seconds, 3) AS purchase_seconds FROM ({_DAYS})")
def run_funnel(spark, sf):
    rows = T.read(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("stage"), F.col("user_id").alias("item"), "ts")
    out = G.funnel(rows, ["view", "click", "purchase"], ts="ts")
    rounded = {"click_share": 6, "purchase_share": 6, "view_seconds": 3, "click_seconds": 3, "purchase_seconds": 3}
    return out.select("run_id", "view", "click", "purchase", *(F.round(c, n).alias(c) for c, n in rounded.items()))


@query("SELECT strftime(ts, '%Y-%m-%d') AS run_id, 's' || CAST(user_id % 4 AS VARCHAR) AS source, count(*) FILTER (event_type = 'view') AS pages, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'error') = 0 AS healthy FROM events GROUP BY 1, 2")
def scraper_health(spark, sf):
    e = T.read(spark, sf, "events").selectExpr("date_format(ts, 'yyyy-MM-dd') as run_id", "'s' || (user_id % 4) as source", "cast(event_type = 'view' as int) as pages", "cast(event_type = 'error' as int) as errors")
    return G.scraper_health(e)


@query("SELECT area AS outcode, bedrooms, quantile_cont(price_pcm, 0.5) AS median, round(avg(price_pcm), 4) AS mean, count(*) AS n FROM listings WHERE notification_status = 'sent' AND postcode IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def rent_benchmarks(spark, sf):
    r = T.listings(spark, sf).where("notification_status = 'sent' and postcode is not null").withColumnRenamed("area", "outcode")
    return G.rent_benchmarks(r).withColumn("mean", F.round("mean", 4))


@query("SELECT run_id, i AS input, o AS output, c AS cache_read, w AS cache_write, round((i * 3.0 + o * 15.0 + c * 0.3 + w * 3.75) / 1e6, 8)::DOUBLE AS cost FROM (SELECT user_id AS run_id, CAST(sum(event_id % 1000) AS BIGINT) AS i, CAST(sum(event_id % 300) AS BIGINT) AS o, CAST(sum(event_id % 70) AS BIGINT) AS c, CAST(sum(event_id % 11) AS BIGINT) AS w FROM events GROUP BY 1)")
def token_cost(spark, sf):
    calls = T.read(spark, sf, "events").selectExpr("user_id as run_id", "event_id % 1000 as input", "event_id % 300 as output", "event_id % 70 as cache_read", "event_id % 11 as cache_write")
    return G.token_cost(calls).withColumn("cost", F.round("cost", 8))


@query("SELECT source, unique_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_seen, unique_id) AS n FROM listings) WHERE n <= 25")
def cap_per_source(spark, sf):
    return G.cap_per_source(T.listings(spark, sf), 25, "source", ["first_seen", "unique_id"]).select("source", "unique_id")


@query("SELECT unique_id, row_number() OVER (ORDER BY item % 2, first_seen, unique_id) > 75 AS deferred FROM listings")
def budget_cap(spark, sf):
    return G.budget_cap(T.listings(spark, sf).withColumn("retry", F.col("item") % 2), 75, ["retry", "first_seen", "unique_id"]).select("unique_id", "deferred")


@query("SELECT DISTINCT item FROM listings WHERE item NOT IN (SELECT item FROM listings WHERE k = 0)")
def absorbed_ids(spark, sf):
    r = T.listings(spark, sf).select("item", "k")
    return r.select("item").distinct().join(r.where("k = 0").select("item"), "item", "left_anti")
