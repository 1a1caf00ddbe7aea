"""Listing-shaped views derived from the driver's tables, by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREAS = ["E2", "E3", "E5", "E8", "E9", "E10", "E15", "E17", "N1", "N5", "N15", "N16", "N17"]
SOURCES = ["openrent", "rightmove", "zoopla", "onthemarket"]


def pick(values: list[str], by: str) -> str:
    """A CASE that takes the value at place `by` modulo their number."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE CAST(({by}) % {len(values)} AS INT) {arms} END)"


P, K = "p_partkey", "k"
_OUT = pick(AREAS, P)
_SRC = pick(SOURCES, K)
DAY = "TIMESTAMP '2025-01-01 00:00:00'"
_FULL = f"({_OUT} || ' ' || CAST({P} % 9 AS STRING) || chr(CAST(65 + {P} % 20 AS INT)) || chr(CAST(65 + {P} % 17 AS INT)))"

LISTING = {
    "unique_id": f"{_SRC} || ':' || CAST({P} AS STRING)",
    "source": _SRC,
    "source_id": f"CAST({P} AS STRING)",
    "item": P,
    "k": f"CAST({K} AS INT)",
    "url": f"'https://www.' || {_SRC} || '.example/' || CAST({P} AS STRING)",
    "title": f"CAST(p_size % 4 AS STRING) || ' bed ' || p_name || (CASE WHEN {P} % 10 = 0 THEN ' Flat Share' ELSE ' flat to rent' END)",
    "price_pcm": f"CAST(floor(p_retailprice) AS INT) + CAST({K} * (({P} % 4) - 1) * 10 AS INT)",
    "bedrooms": "CAST(p_size % 4 AS INT)",
    "area": _OUT,
    "postcode": f"CASE WHEN {P} % 31 = 0 THEN NULL WHEN ({P} + {K}) % 3 = 0 THEN {_OUT} ELSE {_FULL} END",
    "latitude": f"CASE WHEN ({P} + {K}) % 7 = 0 THEN NULL ELSE 51.5e0 + ({P} % 997) * 0.0003e0 + {K} * 0.0001e0 END",
    "longitude": f"CASE WHEN ({P} + {K}) % 7 = 0 THEN NULL ELSE -0.05e0 + ({P} % 991) * 0.0003e0 END",
    "address": f"(CASE WHEN {P} % 4 = 0 THEN 'Flat ' || CAST({P} % 30 AS STRING) || ', ' ELSE '' END) || CAST({P} % 90 AS STRING) || ' ' || p_name || (CASE WHEN {K} = 0 THEN ' St' ELSE ' Street' END) || ', Hackney, London'",
    "description": f"'<p>Bright ' || p_type || ' &amp; ' || p_brand || '</p> EPC rating: C. £' || CAST({P} % 900 + 500 AS STRING) || ' pcm. ' || {pick(['Balcony and dishwasher', 'Private garden, gas central heating', 'Lift, concierge and bike store', 'Unfurnished with parking'], P)} || '. Deposit: 5 weeks rent £900. About the area: busy.'",
    "image_url": f"CASE WHEN {P} % 11 = 0 THEN NULL ELSE 'https://img.example/' || CAST({P} AS STRING) || '.jpg' END",
    "phash": f"substr(md5(CAST({P} AS STRING)), 1, 15) || CAST({K} AS STRING)",
    "first_seen": f"{DAY} + CAST({P} % 90 AS INT) * INTERVAL '1' DAY + CAST({K} AS INT) * INTERVAL '1' HOUR",
    "last_seen": f"{DAY} + CAST({P} % 90 + {P} % 13 AS INT) * INTERVAL '1' DAY + CAST({K} AS INT) * INTERVAL '1' HOUR",
    "merged_id": f"CASE WHEN {P} % 6 = 0 THEN NULL ELSE 'g' || CAST({P} AS STRING) END",
    "enrichment_status": pick(["enriched", "pending", "enriched", "failed", "enriched"], f"{P} + {K}"),
    "notification_status": pick(["sent", "pending", "failed", "sent", "pending_analysis", "dropped", "sent"], f"{P} + {K}"),
    "attempts": f"CAST({P} % 4 AS INT)",
    "is_off_market": f"{P} % 8 = 0",
    "floor_area_sqm": f"CASE WHEN {P} % 5 = 0 THEN NULL ELSE CAST(20 + {P} % 100 AS DOUBLE) END",
}
KEEP = f"({P} * 7 + {K} * 3) % 5 < 3"

_YES = ["yes", "no", "unknown"]
#: One analysis document for each listing, as JSON text.
ANALYSIS = {
    "unique_id": LISTING["unique_id"],
    "overall_rating": f"CASE WHEN {P} % 9 = 0 THEN NULL ELSE CAST({P} % 5 + 1 AS INT) END",
    "fit_score": f"CASE WHEN {P} % 7 = 0 THEN NULL ELSE CAST(({P} * 13 + {K}) % 101 AS INT) END",
    "fit_version": f"CASE WHEN {P} % 12 = 0 THEN NULL ELSE CAST({P} % 3 AS INT) END",
    "has_outdoor_space": f"CASE WHEN {P} % 10 = 0 THEN NULL ELSE {P} % 2 = 0 END",
    "doc": "'{\"overall_rating\":' || CAST(p_partkey % 5 + 1 AS STRING)"
    + " || ',\"condition_concerns\":' || (CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END)"
    + f" || ',\"concern_severity\":\"' || {pick(['serious', 'moderate', 'minor', 'none'], P)}"
    + f" || '\",\"highlights\":[\"' || {pick(['Period features', 'Canal views', 'Open-plan layout', 'Spacious living room', 'Roof terrace'], P)} || '\",\"' || {pick(['Gas hob', ',', 'Park views'], P)}"
    + f" || '\"],\"lowlights\":[\"' || {pick(['Needs updating', 'Small living room', 'No dishwasher'], P)}"
    + f" || '\"],\"kitchen\":{{\"overall_quality\":\"' || {pick(['modern', 'decent', 'dated', 'unknown'], P + '+' + K)} || '\",\"hob_type\":\"' || {pick(['gas', 'electric', 'induction', 'unknown'], P)} || '\",\"has_dishwasher\":\"' || {pick(_YES, P)} || '\",\"has_washing_machine\":\"' || {pick(_YES, P + '+1')}"
    + f" || '\"}},\"light_space\":{{\"natural_light\":\"' || {pick(['excellent', 'good', 'fair', 'poor'], P)} || '\",\"window_sizes\":\"' || {pick(['large', 'medium', 'small'], P)} || '\",\"ceiling_height\":\"' || {pick(['high', 'standard', 'low'], P)} || '\",\"floor_level\":\"' || {pick(['top', 'upper', 'ground', 'basement', 'unknown'], P)} || '\",\"feels_spacious\":' || {pick(['true', 'false', 'null'], P)}"
    + f" || '}},\"space\":{{\"living_room_sqm\":' || CAST(p_partkey % 35 AS STRING) || ',\"total_area_sqm\":' || CAST(25 + p_partkey % 80 AS STRING) || ',\"is_spacious_enough\":' || {pick(['true', 'false', 'null'], P + '+1')} || ',\"hosting_layout\":\"' || {pick(['excellent', 'good', 'awkward', 'poor', 'unknown'], P)}"
    + f" || '\"}},\"value\":{{\"rating\":\"' || {pick(['excellent', 'good', 'fair', 'poor'], P)} || '\",\"quality_adjusted_rating\":' || (CASE WHEN p_partkey % 4 = 1 THEN 'null' ELSE '\"' || {pick(['good', 'excellent', 'fair'], P)} || '\"' END)"
    + f" || '}},\"bedroom\":{{\"can_fit_desk\":\"' || {pick(_YES, P)} || '\",\"office_separation\":\"' || {pick(['dedicated_room', 'separate_area', 'shared_space', 'none', 'unknown'], P)}"
    + f" || '\"}},\"outdoor_space\":{{\"has_balcony\":' || {pick(['true', 'false'], P)} || ',\"has_garden\":' || {pick(['false', 'false', 'true'], P)}"
    + f" || ',\"has_terrace\":false,\"has_shared_garden\":false}},\"flooring_noise\":{{\"primary_flooring\":\"' || {pick(['hardwood', 'tile', 'mixed', 'carpet'], P)} || '\",\"has_double_glazing\":\"' || {pick(_YES, P)} || '\",\"building_construction\":\"' || {pick(['solid_brick', 'concrete', 'timber_frame', 'unknown'], P)} || '\",\"hosting_noise_risk\":\"' || {pick(['low', 'moderate', 'high', 'unknown'], P)} || '\",\"noise_indicators\":[' || (CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '\"road\"' END)"
    + f" || ']}},\"listing_extraction\":{{\"epc_rating\":\"' || {pick(list('ABCDEFG'), P)} || '\",\"pets_allowed\":\"' || {pick(_YES, P)} || '\",\"council_tax_band\":\"' || {pick(list('ABCD'), P)} || '\",\"property_type\":\"' || {pick(['warehouse', 'period_conversion', 'victorian', 'new_build', 'purpose_built', 'unknown'], P)} || '\",\"broadband_type\":\"' || {pick(['fttp', 'cable', 'fttc', 'standard', 'unknown'], P)} || '\",\"bills_included\":\"' || {pick(_YES, P + '+2')} || '\",\"service_charge_pcm\":' || (CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE CAST(p_partkey % 200 AS STRING) END)"
    + " || '},\"listing_red_flags\":{\"red_flag_count\":' || CAST(p_partkey % 3 AS STRING) || '}}'",
}
ANALYSED = f"({P} + {K}) % 5 > 0"

#: Photos: up to four of each listing, some of them EPC charts or floor plans.
IMAGE = {
    "image_id": f"{P} * 16 + {K} * 4 + n",
    "unique_id": LISTING["unique_id"],
    "source": _SRC,
    "url": f"'https://img.example/' || CAST({P} AS STRING) || (CASE WHEN n = 0 AND {P} % 3 = 0 THEN '-epc' ELSE '-' END) || CAST(n AS STRING) || (CASE WHEN n = 3 THEN '.svg?x=1' ELSE '.jpg?w=2' END)",
    "image_type": f"CASE WHEN n = 2 THEN 'floorplan' ELSE 'gallery' END",
    "width": f"CAST(400 + ({P} * (n + 1)) % 700 AS INT)",
    "height": f"CAST(300 + ({P} * (n + 2)) % 500 AS INT)",
    "phash": f"substr(md5(CAST({P} AS STRING) || 'n' || CAST(n AS STRING)), 1, 15) || CAST({K} AS STRING)",
}
PHOTO = f"n <= {P} % 5"


def _times(df: DataFrame, name: str) -> DataFrame:
    """Each row four times, with 0 to 3 under that name. A join, since Spark sees in a join's size that
    the rows become more and in explode's not: a listing side would be broadcast at any size."""
    return df.crossJoin(F.broadcast(df.sparkSession.range(0, 4, 1, 1).select(F.col("id").cast("int").alias(name))))


def _frame(df: DataFrame, columns: dict[str, str], where: str, n: bool = False) -> DataFrame:
    df = _times(df, "k")
    if n:
        df = _times(df, "n").where(PHOTO)
    return df.where(where).selectExpr(*(f"{x} AS {name}" for name, x in columns.items()))


def _cte(name: str, columns: dict[str, str], where: str, n: bool = False) -> str:
    source = "SELECT *, unnest([0, 1, 2, 3]) AS k FROM part"
    if n:
        source = f"SELECT *, unnest([0, 1, 2, 3]) AS n FROM ({source})"
        where = f"{where} AND {PHOTO}"
    return f"{name} AS (SELECT {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM ({source}) WHERE {where})"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Bytes of a method that HotSpot still compiles. Spark's own limit is eight times that, and the methods
#: that make listings or score them lie between, so they would be interpreted row by row.
METHOD_LIMIT = "8000"


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """`part`, dealt to all tasks: its file is a few MB, so Spark reads it in a task or two, which would
    make all listings and whatever follows without a shuffle."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
    return read(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), P)


def tasks(spark: SparkSession, sf: str) -> int:
    """Tasks for what is made of `part` and then sorted: 20,000 parts, some 50,000 listings, in each.
    To be asked for by repartition, which Spark leaves alone: it joins small tasks of other shuffles
    by their compressed size, and listings take a hundred times that in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), read(spark, sf, "part").count() // 20_000 + 1)


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(parts(spark, sf), LISTING, KEEP)


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(parts(spark, sf), ANALYSIS, f"{KEEP} AND {ANALYSED}")


def images(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(parts(spark, sf), IMAGE, KEEP, True)


LISTINGS_SQL = _cte("listings", LISTING, KEEP)
ANALYSES_SQL = _cte("analyses", ANALYSIS, f"{KEEP} AND {ANALYSED}")
IMAGES_SQL = _cte("images", IMAGE, KEEP, True)
#: Unit prices of parts as observations over time, and their changes.
OBS = {"entity": "l_partkey", "obs_id": "l_orderkey * 8 + l_linenumber", "ts": "l_shipdate", "price": "CAST(round(l_extendedprice / l_quantity) AS INT)"}
OBS_SQL = f"obs AS (SELECT {', '.join(f'{x} AS {c}' for c, x in OBS.items())} FROM lineitem)"


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").selectExpr(*(f"{x} AS {c}" for c, x in OBS.items()))
