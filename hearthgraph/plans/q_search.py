"""Scores, search and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthgraph.operators import metrics as M
from hearthgraph.operators import scoring as S
from hearthgraph.operators import search as Q
from hearthgraph.plans.registry import query
from hearthgraph.sources import testdata as T

_FIELDS = ", ".join(f"json_extract_string(doc, '$.{p}') AS {n}" for n, p in S.FIELDS.items())
_UNPACKED = f"SELECT *, {_FIELDS} FROM analyses"
_BASE = "SELECT l.*, u.* EXCLUDE (unique_id, fit_version), u.unique_id IS NOT NULL AS analysed, COALESCE(g.has, false) AS has_gallery, CASE l.item % 3 WHEN 0 THEN 'viewing' WHEN 1 THEN 'new' END AS user_status, CASE l.area WHEN 'E8' THEN 'high' WHEN 'N1' THEN 'low' ELSE 'moderate' END AS tolerance FROM listings l LEFT JOIN unpacked u ON l.unique_id = u.unique_id LEFT JOIN (SELECT unique_id, bool_or(image_type = 'gallery') AS has FROM images GROUP BY 1) g ON l.unique_id = g.unique_id"
_CTE = {"unpacked": _UNPACKED, "base": _BASE}


def base(spark, sf):
    a = S.unpack(T.analyses(spark, sf)).drop("fit_version").withColumn("analysed", F.lit(True))
    g = T.images(spark, sf).groupBy("unique_id").agg(F.bool_or(F.col("image_type") == "gallery").alias("has_gallery"))
    rows = T.listings(spark, sf).repartition(T.tasks(spark, sf), "unique_id")  # the joins follow its tasks
    out = rows.join(a.hint("merge"), "unique_id", "left").join(g.hint("merge"), "unique_id", "left").fillna({"analysed": False, "has_gallery": False})
    return out.withColumns({"user_status": F.when(F.col("item") % 3 == 0, "viewing").when(F.col("item") % 3 == 1, "new"), "tolerance": F.when(F.col("area") == "E8", "high").when(F.col("area") == "N1", "low").otherwise("moderate")})


@query(f"SELECT unique_id, {', '.join(n for n in S.FIELDS if n not in ('tags_up', 'tags_down', 'noises'))} FROM unpacked", unpacked=_UNPACKED)
def json_projections(spark, sf):
    return S.unpack(T.analyses(spark, sf)).select("unique_id", *(n for n in S.FIELDS if n not in ("tags_up", "tags_down", "noises")))


_PARTS = S.fit_parts()
_TOP, _BOT = S.fit_total()


@query(f"SELECT unique_id, CASE WHEN ({_BOT}) > 0 THEN CAST(round_even(({_TOP}) / ({_BOT}), 0) AS INT) END AS fit, {', '.join(f'round({n}, 4) AS {n}' for n in _PARTS)} FROM (SELECT unique_id, {', '.join(f'{x} AS {n}' for n, x in _PARTS.items())} FROM base WHERE analysed)", **_CTE)
def fit_score(spark, sf):
    out = S.fit_score(base(spark, sf).where("analysed"))
    return out.select("unique_id", "fit", *(F.round(n, 4).alias(n) for n in _PARTS))


@query(f"SELECT tier, count(*) AS n FROM (SELECT CASE WHEN f >= 80 THEN 'excellent' WHEN f >= 60 THEN 'good' WHEN f >= 40 THEN 'fair' WHEN f >= 0 THEN 'poor' END AS tier FROM (SELECT round_even(({_TOP}) / ({_BOT}), 0) AS f FROM (SELECT unique_id, {', '.join(f'{x} AS {n}' for n, x in _PARTS.items())} FROM base WHERE analysed))) GROUP BY 1", **_CTE)
def fit_tiers(spark, sf):
    return S.fit_score(base(spark, sf).where("analysed")).groupBy("tier").agg(F.count("*").alias("n"))


@query("""SELECT unique_id, w[1] AS icon_workspace, w[2] AS tip_workspace, h[1] AS icon_hosting, h[2] AS tip_hosting, k[1] AS icon_kitchen, k[2] AS tip_kitchen, v[1] AS icon_vibe, v[2] AS tip_vibe, s[1] AS icon_space, s[2] AS tip_space, i[1] AS icon_internet, i[2] AS tip_internet, outside AS has_outdoor FROM (SELECT unique_id, outside,
 CASE WHEN office = 'dedicated_room' THEN ['good', 'Dedicated office room'] WHEN office = 'separate_area' THEN ['good', 'Separate work area'] WHEN office = 'shared_space' AND bedrooms >= 2 THEN ['neutral', '2-bed but office in shared space'] WHEN office = 'shared_space' THEN ['concern', 'Desk in shared space — no separation'] WHEN office = 'none' THEN ['concern', 'No viable workspace']
  WHEN bedrooms >= 2 THEN ['good', '2+ beds — dedicated office possible'] WHEN desk = 'yes' THEN ['good', 'Can fit desk in bedroom'] WHEN bedrooms = 1 AND spacious = 'true' THEN ['good', 'Spacious 1-bed — desk space likely'] WHEN bedrooms = 0 THEN ['concern', 'Studio — no office separation'] WHEN spacious = 'false' THEN ['concern', 'Compact 1-bed — limited desk space'] ELSE ['neutral', 'Workspace potential unclear'] END AS w,
 CASE spacious WHEN 'true' THEN CASE WHEN walls IN ('solid_brick', 'concrete') OR glazing = 'yes' THEN ['good', 'Spacious + good sound insulation'] ELSE ['neutral', 'Spacious but sound insulation unknown'] END
  WHEN 'false' THEN CASE WHEN noises <> '[]' THEN ['concern', 'Compact space + noise concerns'] WHEN bedrooms >= 2 THEN ['neutral', '2-bed — compact but size less critical'] ELSE ['concern', 'Compact — limited hosting space'] END ELSE ['neutral', 'Hosting suitability unclear'] END AS h,
 CASE WHEN hob IN ('gas', 'induction') THEN ['good', CASE hob WHEN 'gas' THEN 'Gas' ELSE 'Induction' END || ' hob' || CASE WHEN kitchen IN ('modern', 'decent') THEN ', ' || kitchen || ' kitchen' ELSE '' END] WHEN hob = 'electric' THEN ['concern', 'Electric hob' || CASE WHEN kitchen = 'dated' THEN ', dated kitchen' ELSE '' END]
  WHEN kitchen = 'dated' THEN ['concern', 'Dated kitchen'] WHEN kitchen = 'modern' THEN ['neutral', 'Modern kitchen, hob type unknown'] WHEN kitchen = 'decent' THEN ['neutral', 'Decent kitchen, hob type unknown'] ELSE ['neutral', 'Kitchen details unclear'] END AS k,
 CASE kind WHEN 'warehouse' THEN ['good', 'Warehouse — character property'] WHEN 'period_conversion' THEN ['good', 'Period Conversion — character property'] WHEN 'victorian' THEN ['good', 'Victorian — character property'] ELSE CASE WHEN regexp_matches(lower(tags_up), 'period|character|original|warehouse|conversion|high ceiling|exposed') THEN ['good', 'Character features noted']
  WHEN kind = 'new_build' THEN ['neutral', 'New Build'] WHEN kind = 'purpose_built' THEN ['neutral', 'Purpose Built'] ELSE ['neutral', 'Style unclear'] END END AS v,
 CASE WHEN spacious = 'true' THEN ['good', CASE WHEN outside THEN 'Spacious with outdoor space' ELSE 'Spacious layout' END] WHEN spacious = 'false' AND bedrooms >= 2 THEN ['neutral', '2-bed — size less critical'] WHEN spacious = 'false' THEN ['concern', 'Not spacious enough'] WHEN outside THEN ['neutral', 'Has outdoor space, size unclear'] ELSE ['neutral', 'Space unclear'] END AS s,
 CASE broadband WHEN 'fttp' THEN ['good', 'Full fibre (FTTP) available'] WHEN 'fttc' THEN ['neutral', 'Superfast broadband (FTTC)'] WHEN 'cable' THEN ['neutral', 'Cable broadband'] WHEN 'standard' THEN ['concern', 'Basic broadband only'] ELSE ['neutral', 'Broadband not mentioned'] END AS i
 FROM (SELECT *, balcony = 'true' OR garden = 'true' AS outside FROM base WHERE analysed))""", **_CTE)
def lifestyle_icons(spark, sf):
    out = S.lifestyle_icons(base(spark, sf).where("analysed"))
    return out.select("unique_id", *(f"{k}_{x}" for x in ("workspace", "hosting", "kitchen", "vibe", "space", "internet") for k in ("icon", "tip")), "has_outdoor")


@query("""SELECT unique_id, average, price_pcm - average AS difference, CASE WHEN p <= -10 THEN 'excellent' WHEN p <= 0 THEN 'good' WHEN p <= 10 THEN 'fair' WHEN p IS NOT NULL THEN 'poor' END AS value_rating, CASE WHEN price_pcm = average THEN 'At ' || o || ' average' ELSE '£' || format('{:,}', abs(price_pcm - average)) || CASE WHEN price_pcm < average THEN ' below ' ELSE ' above ' END || o || ' average' END AS value_note
 FROM (SELECT *, (price_pcm - average)::DOUBLE / average * 100 AS p FROM (SELECT l.*, CASE WHEN k.o IS NOT NULL THEN b.median ELSE 1100 + 50 * l.bb END AS average FROM (SELECT *, upper(regexp_split_to_array(trim(postcode), '\\s+')[1]) AS o, greatest(1, least(3, bedrooms)) AS bb FROM listings) l
 LEFT JOIN (SELECT DISTINCT area AS o FROM listings WHERE item % 13 < 9) k ON l.o = k.o LEFT JOIN (SELECT area AS o, bedrooms AS bb, CAST(floor(avg(price_pcm)) AS INT) AS median FROM listings WHERE item % 13 < 9 AND bedrooms > 0 GROUP BY 1, 2) b ON l.o = b.o AND l.bb = b.bb))""")
def assess_value(spark, sf):
    r = T.listings(spark, sf)
    bench = r.where("item % 13 < 9 and bedrooms > 0").groupBy(F.col("area").alias("outcode"), "bedrooms").agg(F.floor(F.avg("price_pcm")).cast("int").alias("median"))
    defaults = spark.createDataFrame([(b, 1100 + 50 * b) for b in (1, 2, 3)], "bedrooms int, median int")
    return S.assess_value(r, bench, defaults).select("unique_id", "average", "difference", "value_rating", "value_note")


# Pinned reference amounts.
TAX = [("hackney", "C", 146), ("hackney", "D", 164), ("tower hamlets", "A", 97)]
ENERGY = [("D", 1, 106), ("D", 2, 132), ("B", 1, 70), ("C", 2, 110), ("G", 1, 169)]
SERVICE = [("new_build", 150, 300), ("warehouse", 80, 200)]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query(f"""SELECT unique_id, t AS total, t - COALESCE(s, lo, 0) + COALESCE(s, hi, 0) AS total_high, CAST(round_even(price_pcm * 100e0 / t, 0) AS INT) AS rent_pct FROM (SELECT b.*, lo, hi, CAST(service AS INT) AS s, b.price_pcm + COALESCE(x.amount, 0) + CASE WHEN bills = 'yes' THEN 0 ELSE COALESCE(e.amount, 0) + CASE WHEN bedrooms <= 1 THEN 40 ELSE 50 END + CASE COALESCE(broadband, 'fttp') WHEN 'fttp' THEN 25 WHEN 'unknown' THEN 25 WHEN 'cable' THEN 30 ELSE 0 END END + COALESCE(CAST(service AS INT), lo, 0) AS t FROM base b
 LEFT JOIN (VALUES {_values(TAX)}) x(borough, band, amount) ON x.borough = CASE WHEN area LIKE 'E%' THEN 'hackney' ELSE 'tower hamlets' END AND x.band = b.band LEFT JOIN (VALUES {_values(ENERGY)}) e(epc, beds, amount) ON e.epc = COALESCE(b.epc, 'D') AND e.beds = greatest(1, least(2, bedrooms)) LEFT JOIN (VALUES {_values(SERVICE)}) s(kind, lo, hi) ON s.kind = b.kind)""", **_CTE)
def true_cost(spark, sf):
    b = base(spark, sf).withColumn("borough", F.when(F.col("area").startswith("E"), "hackney").otherwise("tower hamlets"))
    make = spark.createDataFrame
    out = S.true_cost(b, make(TAX, "borough string, band string, amount int"), make(ENERGY, "epc string, beds int, amount int"), make([(1, 40), (2, 50)], "beds int, amount int"), make([("fttp", 25), ("cable", 30)], "type string, amount int"), make(SERVICE, "kind string, low int, high int"))
    return out.select("unique_id", "total", "total_high", "rent_pct")


def half_even(x: str) -> str:
    """SQL for two decimals, halves to even by the decimal value (in units of 1e-9)."""
    y = f"CAST(round(({x}) * 1e9) AS BIGINT)"
    return f"(({y} // 10000000 + CASE WHEN {y} % 10000000 > 5000000 OR ({y} % 10000000 = 5000000 AND {y} // 10000000 % 2 = 1) THEN 1 ELSE 0 END) / 100e0)"


@query(f"""SELECT unique_id, w_days, w_drops, w_benchmark, w_trend, round(w_days + w_drops + w_benchmark + w_trend + 0.3, 6)::DOUBLE AS net, CASE WHEN round(w_days + w_drops + w_benchmark + w_trend + 0.3, 6) >= 1.5 THEN 'strong' WHEN round(w_days + w_drops + w_benchmark + w_trend + 0.3, 6) >= 0.5 THEN 'moderate' WHEN round(w_days + w_drops + w_benchmark + w_trend + 0.3, 6) >= -0.5 THEN 'balanced' ELSE 'limited' END AS strength FROM
 (SELECT unique_id, CASE WHEN days >= 28 THEN 1e0 WHEN days >= 21 THEN {half_even("0.6e0 + 0.4e0 * (days - 21) / 7")} WHEN days >= 14 THEN {half_even("0.4e0 + 0.2e0 * (days - 14) / 7")} WHEN days >= 7 THEN {half_even("0.2e0 + 0.2e0 * (days - 7) / 7")} WHEN days > 0 THEN -0.2e0 ELSE -0.3e0 END AS w_days,
 CASE WHEN nd > 0 THEN {half_even("least(1e0, 0.3e0 + 0.2e0 * (nd - 1) + 0.1e0 * (abs(sd) / 100e0))")} ELSE 0e0 END AS w_drops, CASE WHEN median IS NULL THEN 0e0 ELSE sign(pct) * CASE WHEN abs(pct) <= 5 THEN 0e0 WHEN abs(pct) <= 15 THEN {half_even("0.3e0 + 0.7e0 * (abs(pct) - 5) / 10")} ELSE 1e0 END END AS w_benchmark,
 CASE WHEN yoy IS NULL THEN 0e0 WHEN yoy >= 7 THEN -0.6e0 WHEN yoy >= 3 THEN -0.3e0 WHEN yoy < 0 THEN 0.5e0 ELSE 0.2e0 END AS w_trend FROM (SELECT *, (price_pcm - median) * 100e0 / median AS pct FROM (SELECT unique_id, price_pcm, CAST(item % 35 AS INT) AS days, item % 4 AS nd, -(item % 4) * (item % 300) AS sd, CASE WHEN item % 5 > 0 THEN 900 + item % 400 END AS median, CASE WHEN item % 6 > 0 THEN item % 12 - 2 END::DOUBLE AS yoy FROM listings)))""")
def negotiation(spark, sf):
    r = T.listings(spark, sf).selectExpr("unique_id", "price_pcm", "cast(item % 35 as int) as days", "item % 4 as n_drops", "-(item % 4) * (item % 300) as sum_drops", "case when item % 5 > 0 then 900 + item % 400 end as median", "cast(case when item % 6 > 0 then item % 12 - 2 end as double) as yoy", "'mixed' as direction")
    return S.negotiation(r, F.to_date(F.lit("2025-01-15"))).select("unique_id", "w_days", "w_drops", "w_benchmark", "w_trend", "net", "strength")


_VIS = "COALESCE(enrichment_status, 'enriched') <> 'pending' AND notification_status NOT IN ('pending_analysis', 'dropped') AND (overall_rating IS NOT NULL OR NOT analysed) AND (image_url IS NOT NULL OR has_gallery)"
_FILTERS = [
    (Q.PropertyFilter(min_price=1000, max_price=1600, bedrooms=2), "price_pcm BETWEEN 1000 AND 1600 AND bedrooms = 2 AND NOT is_off_market"),
    (Q.PropertyFilter(min_fit=50, outdoor="no"), "fit_score >= 50 AND NOT COALESCE(has_outdoor_space, false) AND NOT is_off_market"),
    (Q.PropertyFilter(area="e8", off_market="show"), "upper(postcode) LIKE 'E8 %'"),
    (Q.PropertyFilter(value="good", off_market="only"), "(adjusted = 'good' OR value = 'good') AND is_off_market"),
    (Q.PropertyFilter(tags=("canal views",), outdoor="yes"), "(lower(tags_up) LIKE '%canal views%' OR lower(tags_down) LIKE '%canal views%') AND has_outdoor_space AND NOT is_off_market"),
    (Q.PropertyFilter(status="new", min_living=10.0, min_area=40.0), "COALESCE(user_status, 'new') = 'new' AND CAST(living AS DOUBLE) >= 10 AND COALESCE(floor_area_sqm, CAST(total AS DOUBLE)) >= 40 AND NOT is_off_market"),
    (Q.PropertyFilter(equal={"hob": "gas", "light": "excellent"}), "hob = 'gas' AND light = 'excellent' AND NOT is_off_market"),
]


@query(" UNION ALL ".join(f"SELECT {i} AS search, unique_id FROM base WHERE {_VIS} AND {w}" for i, (_, w) in enumerate(_FILTERS)), **_CTE)
def search_filter(spark, sf):
    return Q.search_filters(base(spark, sf), [f for f, _ in _FILTERS]).select("search", "unique_id")


@query(f"SELECT unique_id, price_pcm, fit_score FROM base WHERE {_VIS} AND NOT is_off_market ORDER BY COALESCE(fit_score, -1) DESC, first_seen DESC, unique_id LIMIT 24 OFFSET 24", **_CTE)
def search_page(spark, sf):
    return Q.search_page(base(spark, sf), Q.PropertyFilter(), "fit_desc", 2).select("unique_id", "price_pcm", "fit_score")


@query(f"SELECT count(*) AS total, count(*) FILTER ({_VIS} AND NOT is_off_market) AS shown FROM base", **_CTE)
def count_matching(spark, sf):
    from hearthgraph.operators.filters import every

    hit = every([*Q.visible(), *Q.conditions(Q.PropertyFilter())])
    return base(spark, sf).agg(F.count("*").alias("total"), F.count_if(hit).alias("shown"))


@query(f"""SELECT unique_id AS id, round(latitude, 6)::DOUBLE AS lat, round(longitude, 6)::DOUBLE AS lon, price_pcm AS price, bedrooms, overall_rating AS rating, fit_score, title, '/property/' || unique_id AS url, image_url, postcode,
 CAST(CASE WHEN item % 60 <= 45 THEN item % 60 END AS INT) AS commute_minutes, adjusted AS value_rating, CASE WHEN analysed THEN hob || ' hob' END AS one_line, is_off_market FROM base WHERE {_VIS} AND NOT is_off_market AND latitude IS NOT NULL""", **_CTE)
def map_markers(spark, sf):
    b = base(spark, sf).withColumns({"commute_minutes": F.expr("case when item % 60 <= 45 then cast(item % 60 as int) end"), "one_line": F.when(F.col("analysed"), F.concat("hob", F.lit(" hob")))})
    out = Q.map_markers(b, Q.PropertyFilter())
    return out.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query("SELECT b.unique_id, b.overall_rating, COALESCE(b.floor_area_sqm, CAST(b.total AS DOUBLE)) AS area, CASE WHEN b.floor_area_sqm IS NULL AND b.total IS NOT NULL THEN 'estimated' END AS area_source, b.epc, array_to_string(list_filter(CAST(json_extract(doc, '$.highlights') AS VARCHAR[]), lambda x: x <> '' AND x <> ','), '|') AS tags FROM base b WHERE analysed", **_CTE)
def card_fields(spark, sf):
    b = base(spark, sf).where("analysed")
    tags = F.filter(F.from_json("tags_up", "array<string>"), lambda x: ~x.isin("", ","))
    return b.select("unique_id", "overall_rating", F.coalesce(F.col("floor_area_sqm"), F.col("total").cast("double")).alias("area"), F.when(F.col("floor_area_sqm").isNull() & F.col("total").isNotNull(), "estimated").alias("area_source"), "epc", F.array_join(tags, "|").alias("tags"))


#: Columns of a record on its page; the two times are shown as seconds.
_DETAIL = ["source", "url", "title", "price_pcm", "bedrooms", "address", "postcode", "description", "image_url", "phash", "merged_id", "enrichment_status", "notification_status", "attempts", "is_off_market", "floor_area_sqm"]


@query(f"""SELECT l.unique_id, {', '.join(f'l.{c}' for c in _DETAIL)}, round(l.latitude, 6)::DOUBLE AS latitude, round(l.longitude, 6)::DOUBLE AS longitude, floor(epoch(l.first_seen))::BIGINT AS first_seen, floor(epoch(l.last_seen))::BIGINT AS last_seen, a.overall_rating AS quality_rating, a.doc AS analysis, i.gallery, i.floorplans FROM listings l LEFT JOIN analyses a ON l.unique_id = a.unique_id
 LEFT JOIN (SELECT unique_id, string_agg(CASE WHEN image_type = 'gallery' THEN url END, ' ' ORDER BY image_id) AS gallery, string_agg(CASE WHEN image_type = 'floorplan' THEN url END, ' ' ORDER BY image_id) AS floorplans FROM images GROUP BY 1) i ON l.unique_id = i.unique_id""")
def detail_rows(spark, sf):
    records = T.listings(spark, sf).select("unique_id", *_DETAIL, "latitude", "longitude", "first_seen", "last_seen").repartition(T.tasks(spark, sf), "unique_id")  # the joins follow its tasks
    found = T.analyses(spark, sf).select("unique_id", F.col("overall_rating").alias("quality_rating"), F.col("doc").alias("analysis"))
    out = Q.detail_rows(records, found, T.images(spark, sf).select("unique_id", "image_id", "image_type", "url"))
    listed = [F.nullif(F.array_join(c, " "), F.lit("")).alias(c) for c in ("gallery", "floorplans")]
    return out.select("unique_id", *_DETAIL, *(F.round(c, 6).alias(c) for c in ("latitude", "longitude")), *(F.unix_timestamp(c).alias(c) for c in ("first_seen", "last_seen")), "quality_rating", "analysis", *listed)


_PAIR = "SELECT d.doc_id AS pair_id, l.quality = 1 AS truth, d.n_chars % 3 AS s_a, d.n_chars % 2 AS s_b, d.n_chars % 120 AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _pairs(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", "n_chars").join(T.read(spark, sf, "labels"), "doc_id")
    return d.selectExpr("doc_id as pair_id", "quality = 1 as truth", "n_chars % 3 as s_a", "n_chars % 2 as s_b", "n_chars % 120 as score")


_M = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS r"


@query(f"SELECT tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f05 FROM (SELECT *, {_M} FROM (SELECT count(*) FILTER (score >= 60 AND truth) AS tp, count(*) FILTER (score >= 60 AND NOT truth) AS fp, count(*) FILTER (score < 60 AND NOT truth) AS tn, count(*) FILTER (score < 60 AND truth) AS fn FROM ({_PAIR})))")
def confusion_metrics(spark, sf):
    out = M.confusion(_pairs(spark, sf), F.col("score") >= 60, F.col("truth"))
    return out.select("tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "f1", "f05")))


@query(f"SELECT signal, round(tp_rate, 6) AS tp_rate, round(fp_rate, 6) AS fp_rate, CASE WHEN fp_rate > 0 THEN round(tp_rate / fp_rate, 6) END AS lift FROM (SELECT signal, COALESCE(avg(CASE WHEN truth THEN f END), 0) AS tp_rate, COALESCE(avg(CASE WHEN NOT truth THEN f END), 0) AS fp_rate FROM (SELECT truth, 's_a' AS signal, CAST(s_a > 0 AS DOUBLE) AS f FROM ({_PAIR}) WHERE score >= 60 UNION ALL SELECT truth, 's_b', CAST(s_b > 0 AS DOUBLE) FROM ({_PAIR}) WHERE score >= 60) GROUP BY 1)")
def signal_firing(spark, sf):
    out = M.signal_firing(_pairs(spark, sf), ["s_a", "s_b"], F.col("score") >= 60, F.col("truth"))
    return out.select("signal", *(F.round(c, 6).alias(c) for c in ("tp_rate", "fp_rate", "lift")))


@query(f"SELECT threshold, tp, fp, tn, fn, round(CASE WHEN p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f05 FROM (SELECT *, {_M} FROM (SELECT CAST(t AS INT) AS threshold, count(*) FILTER (score >= t AND truth) AS tp, count(*) FILTER (score >= t AND NOT truth) AS fp, count(*) FILTER (score < t AND NOT truth) AS tn, count(*) FILTER (score < t AND truth) AS fn FROM ({_PAIR}), range(20, 116, 5) g(t) GROUP BY 1))")
def threshold_sweep(spark, sf):
    return M.threshold_sweep(_pairs(spark, sf), F.col("truth")).select("threshold", "tp", "fp", "tn", "fn", F.round("f05", 6).alias("f05"))


_REG = "SELECT CASE WHEN item % 9 = 0 THEN NULL ELSE floor_area_sqm + item % 23 - 11 END AS p, floor_area_sqm AS t FROM listings"


@query(f"SELECT round(avg(abs(p - t)), 6) AS mae, quantile_cont(abs(p - t), 0.5) AS median_ae, round(avg(p - t), 6) AS bias, round(avg(CAST(abs(p - t) <= 3 AS INT)), 6) AS within_3, round(avg(CAST(abs(p - t) <= 5 AS INT)), 6) AS within_5, round(avg(CAST(abs(p - t) <= 10 AS INT)), 6) AS within_10, (SELECT count(*) FROM ({_REG}) WHERE p IS NULL OR t IS NULL) AS skipped FROM ({_REG}) WHERE p IS NOT NULL AND t IS NOT NULL")
def regression_metrics(spark, sf):
    r = T.listings(spark, sf).selectExpr("case when item % 9 = 0 then null else floor_area_sqm + item % 23 - 11 end as p", "floor_area_sqm as t")
    out = M.regression(r, "p", "t")
    return out.select(*(F.round(c, 6).alias(c) if c not in ("skipped", "median_ae") else c for c in out.columns))
