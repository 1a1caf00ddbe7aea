"""Projections and small operators that stand on the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgraph.functions import address as A
from hearthgraph.functions.dates import added_since
from hearthgraph.operators import filters as B
from hearthgraph.operators import history as H
from hearthgraph.operators import linkage as L
from hearthgraph.operators import scoring as S
from hearthgraph.operators import tables as U
from hearthgraph.plans.q_joins import _CH
from hearthgraph.plans.q_search import _CTE, _UNPACKED, base
from hearthgraph.plans.q_tables import _KEY, _files
from hearthgraph.plans.registry import query
from hearthgraph.sources import testdata as T


@query(f"SELECT entity, p_brand, old AS old_price, price AS new_price FROM (SELECT c.*, p_brand, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, obs_id DESC) AS n FROM ({_CH}) c JOIN part ON entity = p_partkey WHERE change < 0 AND p_partkey % 3 > 0 AND p_size % 2 = 0) WHERE n = 1")
def unsent_drops(spark, sf):
    parts = T.parts(spark, sf).selectExpr("p_partkey as entity", "p_brand", "case when p_partkey % 3 > 0 then 'sent' else 'pending' end as notification_status", "p_size % 2 > 0 as told")
    return H.unsent_drops(parts, H.price_changes(T.observations(spark, sf))).select("entity", "p_brand", "old_price", "new_price")


@query("""SELECT item, min_by(unique_id, k) AS unique_id, COALESCE(min_by(postcode, k) FILTER (regexp_matches(postcode, '^[A-Z]+[0-9]+ [0-9][A-Z]{2}$')), min_by(postcode, k)) AS postcode, round(min_by(longitude, k) FILTER (longitude IS NOT NULL), 6)::DOUBLE AS longitude, floor(epoch(min(last_seen)))::BIGINT AS available FROM listings GROUP BY 1""")
def best_canonical(spark, sf):
    order = [F.col("first_seen"), F.col("unique_id")]
    out = T.listings(spark, sf).groupBy("item").agg(
        L.first_by(F.col("unique_id"), *order).alias("unique_id"),
        F.coalesce(L.first_by(F.col("postcode"), *order, where=A.is_full_postcode(F.col("postcode"))), L.first_by(F.col("postcode"), *order)).alias("postcode"),
        F.round(L.first_by(F.col("longitude"), *order, where=F.col("latitude").isNotNull() & F.col("longitude").isNotNull()), 6).alias("longitude"),
        F.unix_timestamp(F.min("last_seen")).alias("available"),
    )
    return out


@query(f"SELECT image_type, count(*) AS images, count(*) FILTER (f IS NULL) AS missing, count(DISTINCT CASE WHEN f IS NULL THEN unique_id END) AS listings FROM (SELECT i.*, c.key AS f FROM (SELECT *, {_KEY} AS key FROM images) i LEFT JOIN (SELECT DISTINCT {_KEY} AS key FROM images WHERE image_id % 5 <> 0) c ON i.key = c.key) GROUP BY 1")
def missing_image_stats(spark, sf):
    im, files = _files(spark, sf)
    seen = im.join(files.distinct().withColumn("f", F.lit(1)), "cache_name", "left")
    return seen.groupBy("image_type").agg(F.count("*").alias("images"), F.count_if(F.col("f").isNull()).alias("missing"), F.countDistinct(F.when(F.col("f").isNull(), F.col("unique_id"))).alias("listings"))


@query("""SELECT b.unique_id, b.price_pcm, b.bedrooms, b.overall_rating, array_to_string(list_filter(CAST(json_extract(doc, '$.highlights') AS VARCHAR[]), lambda x: trim(x) <> '' AND trim(x) <> ','), '|') AS highlights, round_even(COALESCE(b.floor_area_sqm, CAST(b.total AS DOUBLE)), 1) AS area_sqm, CASE WHEN b.floor_area_sqm IS NULL AND b.total IS NOT NULL THEN 'estimated' END AS area_source, COALESCE(b.image_url, f.url) AS photo, c.change AS last_change
 FROM base b LEFT JOIN (SELECT unique_id, url, row_number() OVER (PARTITION BY unique_id ORDER BY image_id) AS n FROM images WHERE image_type = 'gallery' AND lower(url) NOT LIKE '%epc%') f ON b.unique_id = f.unique_id AND f.n = 1 LEFT JOIN (SELECT entity, change, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, obs_id DESC) AS n FROM chg) c ON c.entity = b.item AND c.n = 1 WHERE b.analysed""", **_CTE, chg=_CH)
def card_projection(spark, sf):
    b = base(spark, sf).where("analysed")
    first = B.with_flags(T.images(spark, sf)).where("image_type = 'gallery' and not epc").groupBy("unique_id").agg(F.min_by("url", "image_id").alias("url"))
    last = H.latest_change(H.price_changes(T.observations(spark, sf))).select(F.col("entity").alias("item"), "last_change")
    changes = b.select("unique_id", "item").join(last, "item").select("unique_id", "last_change")
    return S.card_projection(b, first, changes)


@query("""SELECT unique_id, CASE WHEN days >= 28 THEN 'days' ELSE '' END || CASE WHEN days >= 28 AND nd > 0 THEN ',drops' WHEN nd > 0 THEN 'drops' ELSE '' END || CASE WHEN days >= 28 AND nd > 0 THEN '' WHEN days >= 28 OR nd > 0 THEN ',season' ELSE 'season' END AS top_buyer FROM (SELECT unique_id, CASE WHEN item % 2 = 0 THEN 30 ELSE 0 END AS days, item % 3 AS nd FROM listings)""")
def top_signals(spark, sf):
    r = T.listings(spark, sf).selectExpr("unique_id", "price_pcm", "case when item % 2 = 0 then 30 else 0 end as days", "item % 3 as n_drops", "-(item % 3) * 100 as sum_drops", "cast(null as int) as median", "cast(null as double) as yoy", "'none' as direction")
    return S.negotiation(r, F.to_date(F.lit("2025-01-15"))).select("unique_id", "top_buyer")


@query(" UNION ALL ".join(f"SELECT {d} AS days, unique_id FROM listings WHERE first_seen >= TIMESTAMP '2025-03-20 00:00:00' - INTERVAL '{d} days'" for d in (1, 3, 7, 30)))
def added_cutoff(spark, sf):
    now, out = F.lit("2025-03-20 00:00:00").cast("timestamp"), None
    for d in (1, 3, 7, 30):
        one = T.listings(spark, sf).where(added_since(F.col("first_seen").cast("timestamp"), now, d)).select(F.lit(d).alias("days"), "unique_id")
        out = one if out is None else out.union(one)
    return out


@query("SELECT unique_id, balcony = 'true' OR garden = 'true' OR terrace = 'true' OR shared_garden = 'true' AS has_outdoor_space, CAST(red_flags AS INT) AS red_flag_count, upper(epc) AS epc_rating FROM unpacked", unpacked=_UNPACKED)
def denormalise_analysis(spark, sf):
    return S.denormalise(S.unpack(T.analyses(spark, sf)).drop("has_outdoor_space")).select("unique_id", "has_outdoor_space", "red_flag_count", "epc_rating")


@query("SELECT unique_id, CASE WHEN item % 4 = 0 AND merged_id IS NOT NULL THEN NULL ELSE merged_id END AS merged_id FROM listings")
def unlink(spark, sf):
    r = T.listings(spark, sf)
    gone = r.where("item % 4 = 0 and merged_id is not null").select("merged_id").distinct()
    out = U.delete_cascade(gone, gone, "merged_id", {}, {"listings": (r, "merged_id")})
    return out["listings"].select("unique_id", "merged_id")
