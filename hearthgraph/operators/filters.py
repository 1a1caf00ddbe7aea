"""Row filters, queues and guarded changes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgraph.functions import address as A
from hearthgraph.functions import text as X

# Floor areas that are plausible, by bedrooms.
AREA_RANGE = {0: (12, 50), 1: (20, 75), 2: (35, 110), 3: (50, 150)}
AREA_LIMITS = (9, 465)


def every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class Criteria:
    min_price: int
    max_price: int
    min_bedrooms: int
    max_bedrooms: int


def fits(c: Criteria) -> Column:
    return F.col("price_pcm").between(c.min_price, c.max_price) & F.col("bedrooms").between(c.min_bedrooms, c.max_bedrooms)


def criteria_filter(df: DataFrame, c: Criteria) -> DataFrame:
    return df.where(fits(c))


def with_location(df: DataFrame, outcodes: DataFrame, name: str, strict: bool = False) -> DataFrame:
    """df with a flag: its outcode is among outcodes (one column), or it has no postcode, unless strict."""
    known = outcodes.select(F.upper("outcode").alias("_out")).distinct().withColumn("_known", F.lit(True))
    marked = df.withColumn("_out", A.extract_outcode(F.col("postcode"))).join(known, "_out", "left")
    placed = F.col("_known").isNotNull() if strict else F.col("_known").isNotNull() | F.col("postcode").isNull()
    return marked.select(*df.columns, placed.alias(name))


def location_filter(df: DataFrame, outcodes: DataFrame, strict: bool = False) -> DataFrame:
    """Rows whose outcode is among outcodes (one column); rows without a postcode unless strict."""
    return with_location(df, outcodes, "_location", strict).where("_location").drop("_location")


def location_rejects(df: DataFrame, outcodes: DataFrame) -> DataFrame:
    """How many rows location_filter (strict) leaves out, by outcode."""
    keyed = df.withColumn("outcode", A.extract_outcode(F.col("postcode")))
    left = keyed.join(outcodes.select(F.upper("outcode").alias("outcode")).distinct(), "outcode", "left_anti")
    return left.groupBy(F.coalesce("outcode", F.lit("NO_POSTCODE")).alias("outcode")).agg(F.count("*").alias("n"))


def areas_to_outcodes(areas: list[str], boroughs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Area names (boroughs, aliases or outcodes) -> outcode rows. boroughs: borough, outcode."""
    spark = boroughs.sparkSession
    named = spark.createDataFrame([(a.strip(),) for a in areas], "area string")
    named = named.withColumn("alias", F.lower("area")).join(aliases, "alias", "left").withColumn("borough", F.coalesce("borough", F.regexp_replace("alias", r"\s+", "-")))
    own = named.where(A.is_outcode(F.col("area"))).select(F.upper("area").alias("outcode"))
    return own.union(named.where(~A.is_outcode(F.col("area"))).join(boroughs, "borough").select("outcode")).distinct()


def floorplan_gate(df: DataFrame, exempt: list[str], min_gallery: int = 0) -> DataFrame:
    """Rows with a floor plan, all of whose sources are exempt, or with enough gallery photos."""
    ok = F.col("has_floorplan") | (F.size(F.array_except("sources", F.array(*map(F.lit, exempt)))) == 0)
    return df.where(ok | (F.lit(min_gallery > 0) & (F.col("gallery") >= min_gallery)))


def filter_new(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows not yet promoted: ids that were only scraped are not seen."""
    return df.join(seen.where("merged_id is not null").select("unique_id").distinct(), "unique_id", "left_anti")


def require_images(df: DataFrame, images: DataFrame) -> DataFrame:
    has = images.where("image_type in ('gallery', 'floorplan')").select("unique_id").distinct().withColumn("_has", F.lit(True))
    return df.join(has, "unique_id", "left").where("image_url is not null or _has").drop("_has")


QUEUES = {
    "pending": "notification_status = 'pending'",
    "unsent": "notification_status in ('pending', 'failed')",
    "pending_analysis": "notification_status = 'pending_analysis'",
    "unenriched": "enrichment_status = 'pending' and attempts < {most}",
    "anchors": "first_seen >= timestamp'{since}' and coalesce(enrichment_status, 'enriched') <> 'pending'",
    "reanalysis": "reanalysis_requested_at is not null",
    "missing_commute": "commute_minutes is null and latitude is not null and longitude is not null",
    "missing_ward": "ward is null and latitude is not null and longitude is not null",
}


def queued(df: DataFrame, kind: str, most: int = 3, since: str = "1970-01-01") -> DataFrame:
    """Rows of a queue in no order, for joins."""
    return df.where(QUEUES[kind].format(most=most, since=since))


def work_queue(df: DataFrame, kind: str, without: DataFrame | None = None, most: int = 3, since: str = "1970-01-01", outcode: str | None = None) -> DataFrame:
    """Rows of a queue, the longest waiting first; without: ids to leave out; outcode: only full
    postcodes of it."""
    found = queued(df, kind, most, since)
    if outcode is not None:
        found = found.where(F.upper("postcode").startswith(outcode.upper() + " "))
    if without is not None:
        found = found.join(without.select("unique_id").distinct(), "unique_id", "left_anti")
    return found.orderBy("reanalysis_requested_at" if kind == "reanalysis" else "first_seen", "unique_id")


def transition(df: DataFrame, guard: Column, changes: dict[str, Column]) -> DataFrame:
    """Set columns where the guard holds; others keep what they have."""
    hit = F.coalesce(guard, F.lit(False))
    return df.withColumns({c: F.when(hit, new).otherwise(F.col(c)) for c, new in changes.items()} | {"changed": hit})


def mark_enriched(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Records that waited for enrichment (and are in ids) join the normal flow."""
    hit = _named(df, ids)
    return transition(hit, F.col("_in") & (F.col("notification_status") == "pending_enrichment"), {"enrichment_status": F.lit("enriched"), "notification_status": F.lit("pending")}).drop("_in")


def expire_unenriched(df: DataFrame, most: int = 3) -> DataFrame:
    return transition(df, (F.col("enrichment_status") == "pending") & (F.col("attempts") >= most), {"enrichment_status": F.lit("failed")})


def complete_analysis(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Analysed (or passed over) records are due for a notice; the attempt counts."""
    hit = _named(df, ids)
    return transition(hit, F.col("_in") & (F.col("notification_status") == "pending_analysis"), {"notification_status": F.lit("pending"), "analysis_attempts": F.coalesce("analysis_attempts", F.lit(0)) + 1}).drop("_in")


def reset_failed(df: DataFrame, analyses: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Records whose analysis gave no rating wait for it again (their analyses go), unless they
    have been tried `most` times: df with changed and exhausted, and the analyses left."""
    failed = analyses.where("overall_rating is null").select("unique_id").distinct()
    rows = _named(df, failed).withColumn("_failed", F.col("_in") & (F.col("notification_status") != "pending_analysis"))
    tried = F.coalesce("analysis_attempts", F.lit(0))
    rows = rows.withColumn("exhausted", F.col("_failed") & (tried >= most))
    out = transition(rows, F.col("_failed") & (tried < most), {"notification_status": F.lit("pending_analysis")}).drop("_in", "_failed")
    return out, analyses.join(out.where("changed").select("unique_id"), "unique_id", "left_anti")


def notified(df: DataFrame, results: DataFrame) -> DataFrame:
    """results (unique_id, ok): sent, or failed and to be tried again."""
    rows = df.join(results.select("unique_id", "ok"), "unique_id", "left")
    return transition(rows, F.col("ok").isNotNull(), {"notification_status": F.when(F.col("ok"), "sent").otherwise("failed")}).drop("ok")


def request_reanalysis(analyses: DataFrame, records: DataFrame, at: Column, ids: DataFrame | None = None, outcodes: list[str] | None = None) -> DataFrame:
    """Mark the analyses of the ids, of full postcodes of the outcodes, or (without either) of all
    records; asking again moves the time."""
    chosen = records if ids is None else records.join(ids.select("unique_id").distinct(), "unique_id", "left_semi")
    if outcodes:
        chosen = outcode_prefix_filter(chosen, outcodes)
    return transition(_named(analyses, chosen), F.col("_in"), {"reanalysis_requested_at": at}).drop("_in")


def complete_reanalysis(analyses: DataFrame, ids: DataFrame) -> DataFrame:
    return transition(_named(analyses, ids), F.col("_in") & F.col("reanalysis_requested_at").isNotNull(), {"reanalysis_requested_at": F.lit(None).cast("timestamp")}).drop("_in")


def _named(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df with _in: whether its id is among ids."""
    own = ids.select("unique_id").distinct().withColumn("_in", F.lit(True))
    return df.join(own, "unique_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def outcode_prefix_filter(df: DataFrame, outcodes: list[str]) -> DataFrame:
    """Full postcodes of the outcodes (a list that a caller writes); a bare outcode does not match."""
    return df.where(F.upper("postcode").contains(" ") & F.split(F.upper("postcode"), " ")[0].isin([o.upper() for o in outcodes]))


def set_if_null(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), value))


def backfill_outcode(df: DataFrame, area: str) -> DataFrame:
    return df.withColumn("postcode", F.coalesce("postcode", F.when(A.is_outcode(F.col(area)), F.upper(area))))


def floor_area_plausibility(df: DataFrame, area: str = "area_sqm", rooms: str = "room_sum") -> DataFrame:
    """accepted; outside the range for the bedrooms; far from the sum of its rooms."""
    a, s = F.col(area), F.col(rooms)
    low = F.create_map(*[F.lit(x) for b, (lo, _) in AREA_RANGE.items() for x in (b, lo)])
    high = F.create_map(*[F.lit(x) for b, (_, hi) in AREA_RANGE.items() for x in (b, hi)])
    beds = F.least(F.col("bedrooms"), F.lit(3))
    accepted = F.coalesce(a.between(*AREA_LIMITS), F.lit(False))
    return df.withColumns({
        "accepted": accepted,
        "odd_for_beds": accepted & ~F.coalesce(a.between(F.element_at(low, beds), F.element_at(high, beds)), F.lit(True)),
        "odd_for_rooms": accepted & F.coalesce((s > 0) & (F.abs(a - s) > F.greatest(F.lit(5.0), a * 0.15)), F.lit(False)),
    })


def split_enriched(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    has = (F.col("gallery") > 0) | F.col("has_floorplan")
    return df.where(has), df.where(~has)


def pair_summary(df: DataFrame, gallery: str) -> DataFrame:
    """Compact projection; a placeholder main photo gives way to the first of the gallery."""
    stand_in = F.col("image_url").isNull() | F.col("image_url").rlike(r"\.svg|/assets/")
    return df.select("unique_id", "title", "price_pcm", F.when(stand_in, F.col(gallery)).otherwise(F.col("image_url")).alias("image"), F.substring("description", 1, 200).alias("preview"))


def with_flags(images: DataFrame) -> DataFrame:
    return images.withColumns({"epc": X.is_epc_url(F.col("url")), "video": X.is_video_url(F.col("url")), "image": X.is_image_url(F.col("url"))})
