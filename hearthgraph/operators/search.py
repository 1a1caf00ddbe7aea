"""Search over golden records: visibility, optional filters, sorting and pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgraph.operators.filters import every


@dataclass(frozen=True)
class PropertyFilter:
    min_price: int | None = None
    max_price: int | None = None
    bedrooms: int | None = None
    min_fit: int | None = None
    area: str | None = None
    added_days: int | None = None
    status: str | None = None
    outdoor: str | None = None
    value: str | None = None
    tags: tuple[str, ...] = ()
    off_market: str = "hide"
    min_living: float | None = None
    min_area: float | None = None
    equal: dict[str, str] = field(default_factory=dict)  # unpacked analysis field -> value


#: Fields of the analysis that `equal` may name, beside pets (yes only).
EQUAL = ("kind", "light", "hob", "floor", "walls", "office", "layout", "risk", "broadband", "pets")


def visible() -> list[Column]:
    """What is never shown: unenriched, unanalysed, rated by a fallback, or without any photo."""
    return [
        F.coalesce("enrichment_status", F.lit("enriched")) != "pending",
        ~F.col("notification_status").isin("pending_analysis", "dropped"),
        F.col("overall_rating").isNotNull() | ~F.col("analysed"),
        F.col("image_url").isNotNull() | F.col("has_gallery"),
    ]


def conditions(f: PropertyFilter, as_of: Column | None = None) -> list[Column]:
    c, out = F.col, []
    for value, make in (
        (f.min_price, lambda v: c("price_pcm") >= v),
        (f.max_price, lambda v: c("price_pcm") <= v),
        (f.bedrooms, lambda v: c("bedrooms") == v),
        (f.min_fit, lambda v: c("fit_score") >= v),
        (f.area, lambda v: F.upper("postcode").startswith(v.upper() + " ")),
        (f.added_days, lambda v: c("first_seen") >= as_of - F.make_dt_interval(F.lit(v))),
        (f.status, lambda v: F.coalesce("user_status", F.lit("new")) == v),
        (f.value, lambda v: F.coalesce(c("adjusted") == v, F.lit(False)) | (c("value") == v)),
        (f.min_living, lambda v: c("living").cast("double") >= v),
        (f.min_area, lambda v: F.coalesce(c("floor_area_sqm"), c("total").cast("double")) >= v),
    ):
        if value is not None:
            out.append(make(value))
    if f.outdoor:
        out.append(c("has_outdoor_space") if f.outdoor == "yes" else ~F.coalesce("has_outdoor_space", F.lit(False)))
    for name, value in f.equal.items():
        if name not in EQUAL:
            raise ValueError(f"no filter on {name}")
        out.append(c(name) == value)
    for tag in f.tags:
        out.append(F.coalesce(F.lower("tags_up").contains(tag.lower()), F.lit(False)) | F.coalesce(F.lower("tags_down").contains(tag.lower()), F.lit(False)))
    if f.off_market != "show":
        out.append(F.coalesce("is_off_market", F.lit(False)) == (f.off_market == "only"))
    return out


def search_filter(df: DataFrame, f: PropertyFilter, as_of: Column | None = None) -> DataFrame:
    return df.where(every([*visible(), *conditions(f, as_of)]))


def search_filters(df: DataFrame, filters: list[PropertyFilter], as_of: Column | None = None) -> DataFrame:
    """Several searches over rows that are made once: each row as often as filters find it, with the
    filter's place as search."""
    found = F.array(*(F.when(every(conditions(f, as_of)), F.lit(i)) for i, f in enumerate(filters)))
    return df.where(every(visible())).withColumn("search", F.explode(F.array_compact(found)))


def order_by(sort: str) -> list[Column]:
    newest = [F.desc("first_seen"), F.asc("unique_id")]
    return {
        "price_asc": [F.asc("price_pcm"), F.asc("unique_id")],
        "price_desc": [F.desc("price_pcm"), F.asc("unique_id")],
        "fit_desc": [F.coalesce("fit_score", F.lit(-1)).desc(), *newest],
        "longest": [F.asc("first_seen"), F.asc("unique_id")],
    }.get(sort, newest)


def search_page(df: DataFrame, f: PropertyFilter, sort: str, page: int, per: int = 24) -> DataFrame:
    """One page; unknown sorts mean newest first. Sorting and limit become a top list."""
    return search_filter(df, f).orderBy(*order_by(sort)).offset((page - 1) * per).limit(per)


def map_markers(df: DataFrame, f: PropertyFilter, as_of: Column | None = None) -> DataFrame:
    """What a map shows of every home that a search finds and that has a place: no order, no pages."""
    c = F.col
    shown = {
        "id": c("unique_id"), "lat": c("latitude"), "lon": c("longitude"), "price": c("price_pcm"), "bedrooms": c("bedrooms"), "rating": c("overall_rating"),
        "fit_score": c("fit_score"), "title": c("title"), "url": F.concat(F.lit("/property/"), "unique_id"), "image_url": c("image_url"), "postcode": c("postcode"),
        "commute_minutes": c("commute_minutes"), "value_rating": c("adjusted"), "one_line": c("one_line"), "is_off_market": F.coalesce("is_off_market", F.lit(False)),
    }
    return search_filter(df, f, as_of).dropna(subset=["latitude", "longitude"]).select(*(x.alias(n) for n, x in shown.items()))


def detail_rows(records: DataFrame, analyses: DataFrame, images: DataFrame) -> DataFrame:
    """Every record with all its columns, its analysis (unique_id and what else there is; null without
    one), and the URLs of its photos and of all its floor plans, each in the order of image_id."""
    urls = lambda kind: F.array_sort(F.collect_list(F.when(F.col("image_type") == kind, F.struct("image_id", "url"))))["url"]
    shown = images.groupBy("unique_id").agg(urls("gallery").alias("gallery"), urls("floorplan").alias("floorplans"))
    none = F.array().cast("array<string>")
    # never broadcast: documents and lists of URLs are far larger than what files show of them
    out = records.join(analyses.hint("merge"), "unique_id", "left").join(shown.hint("merge"), "unique_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("gallery", "floorplans")})


def hardest_pairs(pairs: DataFrame, at: float, n: int, by: str = "boundary") -> DataFrame:
    """The n pairs nearest to the threshold (boundary), of the highest score (high), or the lowest
    (low)."""
    order = {"boundary": F.abs(F.col("score") - at), "high": F.desc("score"), "low": F.asc("score")}[by]
    return pairs.orderBy(order, "pair_id").limit(n)
