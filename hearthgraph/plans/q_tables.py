"""Sources, table maintenance, filters, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgraph.operators import filters as B
from hearthgraph.operators import tables as U
from hearthgraph.plans.registry import query
from hearthgraph.sources import files
from hearthgraph.sources import testdata as T

_OUT = "nullif(regexp_extract(upper(trim(postcode)), '^([A-Z]{1,2}\\d{1,2}[A-Z]?)', 1), '')"
_SHOWN = "unique_id, price_pcm, bedrooms, postcode"
_KEY = "image_type || '-' || substr(md5(url), 1, 8)"


def _shown(df):
    return df.select("unique_id", "price_pcm", "bedrooms", "postcode")


def _files(spark, sf):
    im = T.images(spark, sf).withColumn("cache_name", F.concat_ws("-", "image_type", F.substring(F.md5("url"), 1, 8)))
    return im, im.where("image_id % 5 <> 0").select("cache_name")


@query("SELECT unique_id, epoch(first_seen)::BIGINT AS seen FROM listings ORDER BY first_seen DESC, unique_id")
def scan_listings(spark, sf):
    return files.scan_listings(T.listings(spark, sf)).select("unique_id", F.unix_timestamp("first_seen").alias("seen"))


@query("SELECT item AS id, min(price_pcm) AS price FROM (SELECT item, price_pcm, row_number() OVER (PARTITION BY item ORDER BY k) AS n FROM listings) WHERE n = 1 GROUP BY 1")
def load_snapshots(spark, sf):
    from hearthgraph.sources.snapshots import scratch_dir

    root = scratch_dir(spark)
    for k in range(4):
        T.listings(spark, sf).where(F.col("k") == k).select(F.col("item").alias("id"), F.col("price_pcm").alias("price")).write.json(f"{root}/{k}")
    paths = [f"{root}/{k}" for k in range(4)]
    return files.load_snapshots(spark, paths, "id long, price int", "id", lines=True)


@query("SELECT DISTINCT area AS outcode, CAST(bedrooms AS VARCHAR) AS beds, max(price_pcm) OVER (PARTITION BY area, bedrooms) AS median FROM listings")
def load_dims(spark, sf):
    per = T.listings(spark, sf).groupBy("area", "bedrooms").agg(F.max("price_pcm").alias("m"))
    inner = per.groupBy("area").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bedrooms").cast("string"), "m"))).alias("x"))
    doc = inner.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("area", "x")))).alias("doc"))  # a dimension: a row for each area
    return files.load_dim(doc, "doc", "outcode", "beds", "median")


@query("""SELECT COALESCE(t.unique_id, u.unique_id) AS unique_id, CASE WHEN t.unique_id IS NULL THEN u.price WHEN u.unique_id IS NULL THEN t.price ELSE u.price END AS price, CASE WHEN t.unique_id IS NULL THEN u.postcode WHEN u.unique_id IS NULL THEN t.postcode ELSE COALESCE(u.postcode, t.postcode) END AS postcode,
 CASE WHEN t.unique_id IS NULL THEN u.title WHEN u.unique_id IS NULL THEN t.title ELSE t.title END AS title, CASE WHEN t.unique_id IS NULL THEN u.tries WHEN u.unique_id IS NULL THEN t.tries ELSE t.tries + 1 END AS tries, CASE WHEN t.unique_id IS NULL THEN u.top WHEN u.unique_id IS NULL THEN t.top ELSE greatest(t.top, u.top) END AS top
 FROM (SELECT unique_id, price_pcm AS price, postcode, title, attempts AS tries, price_pcm AS top FROM listings WHERE item % 3 > 0) t FULL JOIN
 (SELECT unique_id, price_pcm + 5 AS price, CASE WHEN item % 2 = 0 THEN NULL ELSE 'X1 1XX' END AS postcode, 'new' AS title, 1 AS tries, price_pcm - 7 AS top FROM listings WHERE item % 3 < 2) u ON t.unique_id = u.unique_id""")
def merge_upsert(spark, sf):
    r = T.listings(spark, sf)
    t = r.where("item % 3 > 0").selectExpr("unique_id", "price_pcm as price", "postcode", "title", "attempts as tries", "price_pcm as top")
    u = r.where("item % 3 < 2").selectExpr("unique_id", "price_pcm + 5 as price", "case when item % 2 = 0 then null else 'X1 1XX' end as postcode", "'new' as title", "1 as tries", "price_pcm - 7 as top")
    return U.merge_upsert(t, u, ["unique_id"], {"postcode": "coalesce_new", "title": "keep", "tries": "increment", "top": "max"})


@query("""SELECT COALESCE(t.unique_id, u.unique_id) AS unique_id, CASE WHEN t.unique_id IS NULL THEN 'dropped' WHEN u.unique_id IS NOT NULL AND t.status = 'pending' THEN 'dropped' ELSE t.status END AS status
 FROM (SELECT unique_id, notification_status AS status FROM listings WHERE item % 3 > 0) t FULL JOIN (SELECT unique_id FROM listings WHERE item % 3 < 2) u ON t.unique_id = u.unique_id""")
def conditional_upsert(spark, sf):
    r = T.listings(spark, sf)
    t = r.where("item % 3 > 0").select("unique_id", F.col("notification_status").alias("status"))
    u = r.where("item % 3 < 2").select("unique_id", F.lit("dropped").alias("status"))
    return U.merge_upsert(t, u, ["unique_id"], {}, guard=F.col("status") == "pending")


@query("SELECT COALESCE(t.unique_id, u.unique_id) AS unique_id, CASE WHEN t.unique_id IS NULL THEN 1 WHEN u.unique_id IS NULL THEN t.attempts ELSE t.attempts + 1 END AS attempts FROM (SELECT unique_id, attempts FROM listings WHERE item % 2 = 0) t FULL JOIN (SELECT unique_id FROM listings WHERE item % 3 = 0) u ON t.unique_id = u.unique_id")
def retry_upsert(spark, sf):
    r = T.listings(spark, sf)
    t, u = r.where("item % 2 = 0").select("unique_id", "attempts"), r.where("item % 3 = 0").select("unique_id", F.lit(1).alias("attempts"))
    return U.merge_upsert(t, u, ["unique_id"], {"attempts": "increment"})


@query("SELECT unique_id, min(v) AS v FROM (SELECT unique_id, 'old' AS v FROM listings WHERE item % 2 = 0 UNION ALL SELECT unique_id, 'new' FROM listings WHERE item % 2 = 1 AND item % 3 = 0) GROUP BY 1")
def insert_ignore(spark, sf):
    r = T.listings(spark, sf)
    new = r.where("item % 3 = 0").select("unique_id", F.lit("new").alias("v"))
    return U.insert_ignore(r.where("item % 2 = 0").select("unique_id", F.lit("old").alias("v")), new.union(new), ["unique_id"])


@query("SELECT 'parent' AS tbl, count(*) AS n, count(unique_id) AS linked FROM listings WHERE item % 4 > 0 UNION ALL SELECT 'images', count(*), count(*) FROM images WHERE (image_id // 16) % 4 > 0 UNION ALL SELECT 'links', count(*), count(CASE WHEN item % 4 > 0 THEN 1 END) FROM listings")
def delete_cascade(spark, sf):
    r, im = T.listings(spark, sf), T.images(spark, sf)
    out = U.delete_cascade(r.select("unique_id"), r.where("item % 4 = 0"), "unique_id", {"images": (im, "unique_id")}, {"links": (r.select("item", "unique_id"), "unique_id")})
    parts = [out[t].agg(F.lit(t).alias("tbl"), F.count("*").alias("n"), F.count("unique_id").alias("linked")) for t in ("parent", "images", "links")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def append_events(spark, sf):
    from hearthgraph.sources.snapshots import scratch_dir

    path = scratch_dir(spark) + "/events"
    e = T.read(spark, sf, "events").withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
    U.append_events(e.select("run_id", "event_id", "event_type", "value"), path, ["value"])
    back = spark.read.schema("run_id string, event_id long, event_type string, metadata_json string").parquet(path)
    return back.where("metadata_json is not null").groupBy("run_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 3)")
def retain_last_runs(spark, sf):
    e = T.read(spark, sf, "events").withColumn("run_id", F.to_date("ts"))
    runs = e.groupBy("run_id").agg(F.min("ts").alias("started_at"))
    return U.retain_last_runs(e, runs, 3).select("event_id")


@query("SELECT unique_id, '[\"' || source || '\",\"' || area || '\"]' AS tags, source || ',' || area AS back, 0 AS missing FROM listings")
def encode_json_cols(spark, sf):
    d = T.listings(spark, sf).select("unique_id", F.array("source", "area").alias("tags"), F.lit(None).cast("string").alias("none"))
    e = U.encode_json(d, ["tags"]).withColumn("back", F.col("tags"))
    return U.decode_json(e, {"back": "array<string>", "none": "map<string,string>"}).select("unique_id", "tags", F.array_join("back", ",").alias("back"), F.size("none").alias("missing"))


@query("SELECT unique_id, CASE WHEN source = area THEN '[\"' || area || '\"]' ELSE '[\"' || source || '\",\"' || area || '\"]' END AS tags FROM listings")
def dedupe_json_array(spark, sf):
    doc = F.to_json(F.array("source", "area", "source", "area"))
    return T.listings(spark, sf).select("unique_id", U.dedupe_json_array(doc).alias("tags"))


@query(f"""SELECT unique_id, count(*) AS images, CAST(sum(CASE WHEN image_type = 'gallery' AND f IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_gallery, CAST(sum(CASE WHEN image_type = 'floorplan' AND f IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_floorplan, count(f) = 0 AS loses_all
 FROM (SELECT i.*, c.key AS f FROM (SELECT *, {_KEY} AS key FROM images) i LEFT JOIN (SELECT DISTINCT {_KEY} AS key FROM images WHERE image_id % 5 <> 0) c ON i.key = c.key) GROUP BY 1""")
def image_audit(spark, sf):
    im, files = _files(spark, sf)
    return U.image_audit(im.select("unique_id", "image_type", "cache_name").repartition(T.tasks(spark, sf), "cache_name"), files)


@query(f"""SELECT unique_id, count(*) AS expected, count(f) AS cached, count(f) < count(*) AS partial FROM (SELECT g.unique_id, c.key AS f FROM (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY unique_id ORDER BY image_id) AS n FROM images WHERE image_type = 'gallery') g
 JOIN (SELECT unique_id, max(CASE WHEN image_type = 'floorplan' THEN 1 ELSE 0 END) AS plan FROM images GROUP BY 1) p ON g.unique_id = p.unique_id LEFT JOIN (SELECT DISTINCT {_KEY} AS key FROM images WHERE image_id % 5 <> 0) c ON g.key = c.key WHERE g.n <= 3 - p.plan) GROUP BY 1""")
def gallery_coverage(spark, sf):
    return U.gallery_coverage(*_files(spark, sf), cap=3)


@query(f"SELECT {_SHOWN} FROM listings WHERE price_pcm BETWEEN 950 AND 1400 AND bedrooms BETWEEN 1 AND 2")
def criteria_filter(spark, sf):
    return _shown(B.criteria_filter(T.listings(spark, sf), B.Criteria(950, 1400, 1, 2)))


@query(f"SELECT {_SHOWN} FROM listings WHERE postcode IS NULL OR {_OUT} IN ('E5', 'E8', 'E9', 'E10', 'N1', 'N4', 'N5', 'N15', 'N16', 'E17')")
def location_filter(spark, sf):
    boroughs = T.listings(spark, sf).select(F.when(F.col("area").isin("E5", "E8", "E9", "E10", "N1", "N5", "N15", "N16"), "hackney").otherwise("other").alias("borough"), F.col("area").alias("outcode")).distinct()
    aliases = spark.createDataFrame([("london borough of hackney", "hackney")], "alias string, borough string")
    return _shown(B.location_filter(T.listings(spark, sf), B.areas_to_outcodes(["London Borough of Hackney", "E17"], boroughs, aliases)))


@query(f"SELECT COALESCE({_OUT}, 'NO_POSTCODE') AS outcode, count(*) AS n FROM listings WHERE {_OUT} IS NULL OR {_OUT} NOT IN ('E2', 'N1') GROUP BY 1")
def location_rejects(spark, sf):
    return B.location_rejects(T.listings(spark, sf), spark.createDataFrame([("E2",), ("n1",)], "outcode string"))


_GOLD = "SELECT item, array_agg(source ORDER BY k) AS sources, count(*) AS gallery, bool_or(item % 3 = 0 AND k = 0) AS has_floorplan FROM listings GROUP BY item"


def _gold(spark, sf):
    return T.listings(spark, sf).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("k", "source")))["source"].alias("sources"), F.count("*").alias("gallery"), F.bool_or((F.col("item") % 3 == 0) & (F.col("k") == 0)).alias("has_floorplan"))


@query(f"SELECT item FROM ({_GOLD}) WHERE has_floorplan OR len(list_filter(sources, lambda s: s <> 'openrent' AND s <> 'zoopla')) = 0 OR gallery >= 3")
def floorplan_gate(spark, sf):
    return B.floorplan_gate(_gold(spark, sf), ["openrent", "zoopla"], 3).select("item")


@query(f"SELECT CASE WHEN gallery > 2 OR has_floorplan THEN 'enriched' ELSE 'retry' END AS kind, count(*) AS n FROM ({_GOLD}) GROUP BY 1")
def split_enriched(spark, sf):
    done, retry = B.split_enriched(_gold(spark, sf).withColumn("gallery", F.greatest(F.col("gallery") - 2, F.lit(0))))
    return done.select(F.lit("enriched").alias("kind")).union(retry.select(F.lit("retry").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT unique_id FROM listings WHERE item % 4 > 0 OR merged_id IS NULL")
def filter_new(spark, sf):
    r = T.listings(spark, sf)
    return B.filter_new(r, r.where("item % 4 = 0")).select("unique_id")


@query("SELECT unique_id FROM listings WHERE image_url IS NOT NULL OR unique_id IN (SELECT unique_id FROM images WHERE image_type IN ('gallery', 'floorplan'))")
def require_images(spark, sf):
    return B.require_images(T.listings(spark, sf), T.images(spark, sf)).select("unique_id")


@query("SELECT unique_id FROM listings WHERE upper(postcode) LIKE 'E8 %' OR upper(postcode) LIKE 'N16 %'")
def outcode_prefix_filter(spark, sf):
    return B.outcode_prefix_filter(T.listings(spark, sf), ["e8", "N16"]).select("unique_id")


@query("SELECT unique_id, COALESCE(floor_area_sqm, 42) AS floor_area_sqm, COALESCE(postcode, area) AS postcode FROM listings")
def set_if_null(spark, sf):
    d = B.set_if_null(T.listings(spark, sf), "floor_area_sqm", F.lit(42.0))
    return B.backfill_outcode(d, "area").select("unique_id", "floor_area_sqm", "postcode")


@query("""SELECT unique_id, COALESCE(a BETWEEN 9 AND 465, false) AS accepted, COALESCE(a BETWEEN 9 AND 465, false) AND NOT COALESCE(a BETWEEN [12, 20, 35, 50][b + 1] AND [50, 75, 110, 150][b + 1], true) AS odd_for_beds, COALESCE(a BETWEEN 9 AND 465 AND s > 0 AND abs(a - s) > greatest(5.0, a * 0.15), false) AS odd_for_rooms
 FROM (SELECT unique_id, CASE WHEN item % 6 = 0 THEN NULL ELSE CAST(item % 500 AS DOUBLE) END AS a, CAST((item * 3) % 160 AS DOUBLE) AS s, least(bedrooms, 3) AS b FROM listings)""")
def floor_area_plausibility(spark, sf):
    r = T.listings(spark, sf).withColumns({"area_sqm": F.when(F.col("item") % 6 != 0, (F.col("item") % 500).cast("double")), "room_sum": ((F.col("item") * 3) % 160).cast("double")})
    return B.floor_area_plausibility(r).select("unique_id", "accepted", "odd_for_beds", "odd_for_rooms")


@query("SELECT unique_id, price_pcm, CASE WHEN image_url IS NULL THEN url ELSE image_url END AS image, substr(description, 1, 200) AS preview FROM listings")
def pair_summary(spark, sf):
    return B.pair_summary(T.listings(spark, sf), "url").select("unique_id", "price_pcm", "image", "preview")


@query("SELECT origin, count(*) AS n FROM (SELECT 'new' AS origin FROM listings WHERE item % 2 = 0 UNION ALL SELECT 'anchor' FROM listings WHERE item % 2 = 1) GROUP BY 1")
def union_with_anchors(spark, sf):
    r = T.listings(spark, sf)
    both = r.where("item % 2 = 0").withColumn("origin", F.lit("new")).unionByName(r.where("item % 2 = 1").select("unique_id", F.lit("anchor").alias("origin")), allowMissingColumns=True)
    return both.groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT item, array_to_string(list_filter(s, lambda x: x <> 'zoopla'), ',') AS fresh, list_contains(s, 'zoopla') AS overlaps FROM (SELECT item, array_agg(source ORDER BY k) AS s FROM listings GROUP BY 1)")
def source_sets(spark, sf):
    z = F.array(F.lit("zoopla"))
    return _gold(spark, sf).select("item", F.array_join(F.array_except("sources", z), ",").alias("fresh"), F.arrays_overlap("sources", z).alias("overlaps"))
