"""End-to-end jobs: linking against anchors, the funnel, availability, price changes, evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgraph.functions import address as A
from hearthgraph.functions import text as X
from hearthgraph.operators import aggregates as G
from hearthgraph.operators import filters as B
from hearthgraph.operators import history as H
from hearthgraph.operators import joins as J
from hearthgraph.operators import linkage as L
from hearthgraph.operators import metrics as M
from hearthgraph.operators import scoring as S
from hearthgraph.operators import tables as U
from hearthgraph.sources.snapshots import stored

# The extended scorer's weights, thresholds below which a similarity does not count,
# and what a pair needs to match. Signals of weight 0 are there for other weights to be tried.
EXT_WEIGHTS = {
    "full_postcode": 40.0, "outcode": 10.0, "coordinates": 40.0, "street": 20.0, "price": 15.0, "tfidf": 15.0, "gallery": 40.0, "embeddings": 25.0,
    "fuzzy_address": 0.0, "address_number": 0.0, "title": 0.0, "semantic": 0.0, "features": 0.0,
}
EXT_LEAST = {"tfidf": 0.5, "embeddings": 0.75, "fuzzy_address": 0.75, "title": 0.70, "semantic": 0.60, "features": 0.50}
EXT_MATCH_AT = 70.0
#: Signal -> the column of pairs that it reads.
EXT_COLUMNS = {"tfidf": "tfidf", "embeddings": "embedding_similarity", "fuzzy_address": "fuzzy_address", "title": "title_similarity", "semantic": "semantic_similarity", "features": "feature_overlap"}


def _reaches(name: str, least: dict[str, float]) -> Callable[[], Column]:
    c = EXT_COLUMNS[name]
    return lambda: F.when(F.col(c) >= least[name], F.col(c)).otherwise(0.0)


def ext_signals(least: dict[str, float] | None = None) -> dict[str, Callable[[], Column]]:
    """The thirteen signals. Photos: 0.5, 0.85 and 1 for one, two and more alike. Numbers in the
    addresses: 1 if one is shared, -1 if both have some and none is (another flat)."""
    limits = EXT_LEAST | (least or {})
    n = F.col
    return {k: L.SIGNALS[k] for k in ("full_postcode", "outcode", "coordinates", "street", "price")} | {k: _reaches(k, limits) for k in EXT_COLUMNS} | {
        "gallery": lambda: F.when(n("gallery_matches") >= 3, 1.0).when(n("gallery_matches") == 2, 0.85).when(n("gallery_matches") == 1, 0.5).otherwise(0.0),
        "address_number": lambda: F.coalesce(n("address_number"), F.lit(0.0)),
    }


def shared_number(x: Column, y: Column) -> Column:
    """address_number of the numbers in two addresses."""
    same = lambda i, j: F.coalesce(F.get(x, F.lit(i)) == F.get(y, F.lit(j)), F.lit(False))
    few = (F.size(x) <= 2) & (F.size(y) <= 2)  # as nearly all addresses have; compared without making sets
    shared = F.when(few, same(0, 0) | same(0, 1) | same(1, 0) | same(1, 1)).otherwise(F.arrays_overlap(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.when(shared, 1.0).otherwise(-1.0))


def text_signals(pairs: DataFrame) -> DataFrame:
    """pairs (address, title and description, _a and _b) with what the extended scorer reads of
    texts: fuzzy_address, address_number, title_similarity and feature_overlap."""
    both = lambda f, c: (f(F.col(f"{c}_a")), f(F.col(f"{c}_b")))
    return pairs.withColumns({
        "address_number": shared_number(*both(A.address_numbers, "address")),
        "fuzzy_address": L.token_ratio("sort")(*both(lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), "address")),
        "title_similarity": L.token_ratio("set")(*both(X.clean_title, "title")),
        "feature_overlap": X.jaccard(*both(X.feature_set, "description")),
    })


def text_weight(columns: list[str], weights: dict | None = None) -> float:
    """The weights of what text_signals gives from these columns of a record, added up."""
    w = EXT_WEIGHTS | (weights or {})
    texts = {"address": ("address_number", "fuzzy_address"), "title": ("title",), "description": ("features",)}
    return sum(max(w[x], 0.0) for c, names in texts.items() if c in columns for x in names)


def street_can_match(columns: list[str], weights: dict | None = None, match_at: float = EXT_MATCH_AT) -> bool:
    """Whether a pair without a shared postcode, photo or place can match: the weights of outcode,
    street and price and of what text_signals gives from these columns of a record, added up. Where
    they stay below match_at, strong_pairs needs no pairs of one street."""
    w = EXT_WEIGHTS | (weights or {})
    return sum(max(w[k], 0.0) for k in ("outcode", "street", "price")) + text_weight(columns, weights) >= match_at


def match_score_ext(pairs: DataFrame, weights: dict | None = None, match_at: float = EXT_MATCH_AT, least: dict | None = None) -> DataFrame:
    """match_score with the extended signals, weights and thresholds (those given replace the usual
    ones); signals whose column is absent do not fire. Pairs that can match without a shared
    postcode, photo or place share their street: strong_pairs(..., street=True) finds them all."""
    for c in (*EXT_COLUMNS.values(), "gallery_matches", "address_number"):
        if c not in pairs.columns:
            pairs = pairs.withColumn(c, F.lit(0.0))
    return L.match_score(pairs, ext_signals(least), EXT_WEIGHTS | (weights or {}), match_at)


#: What a record is compared by; sources or source, hash of the main photo where there is one.
COMPARED = ("unique_id", "source", "sources", "price_pcm", "bedrooms", "postcode", "address", "latitude", "longitude", "first_seen", "phash")


def resolve_against_anchors(new: DataFrame, anchors: DataFrame, block: tuple[str, ...] = ("outcode", "bedrooms"), images: DataFrame | None = None, as_of: Column | None = None, days: int = 30, retries: DataFrame | None = None) -> DataFrame:
    """Fate of each new record, against the anchors first seen in the last `days` before as_of
    (all, without one): genuinely_new (the first of a group without an anchor),
    merged_into_anchor, or consumed_retry (a row of retries that is not new, whose stored row is to
    go). With it the earliest anchor of its group, whether the group brings the anchor a source it
    has not (the anchor is then due for analysis again), and what the lowest of its new prices
    changes.

    Records pair inside a block only, so anchors of blocks without a new record are left out, and
    of records only what is compared is carried."""
    if as_of is not None:
        anchors = anchors.where(F.col("first_seen") >= as_of - F.make_dt_interval(F.lit(days)))
    used = [c for c in COMPARED if c in new.columns and c in anchors.columns]
    new = stored(new.select(used), "new-records")
    blocks = stored(L.keyed(new).select(*block).dropna().distinct(), "new-blocks")
    anchors = L.keyed(anchors.select(used)).join(blocks, list(block), "left_semi").select(used)
    both = L.with_sources(new.withColumn("is_anchor", F.lit(False)).unionByName(anchors.withColumn("is_anchor", F.lit(True))))
    groups = L.group_matches(L.qualifying_pairs(both, list(block), images), list(block))
    rows = L.grouped(both.select("unique_id", "is_anchor", "first_seen", "price_pcm", "sources"), groups)
    order = F.struct("first_seen", "unique_id")
    anchor, fresh = F.when(F.col("is_anchor"), order), F.when(~F.col("is_anchor"), F.col("price_pcm"))
    empty = F.array().cast("array<string>")
    lead = rows.groupBy("group_id").agg(
        F.min_by("unique_id", anchor).alias("anchor_id"),
        F.min_by("price_pcm", anchor).alias("anchor_price"),
        F.min_by("sources", anchor).alias("had"),
        F.flatten(F.collect_list(F.when(~F.col("is_anchor"), F.col("sources")).otherwise(empty))).alias("brought"),
        F.min(fresh).alias("lowest"),
        F.min_by("unique_id", order).alias("first_id"),
    )
    brings = F.coalesce(F.size(F.array_except("brought", "had")) > 0, F.lit(False))
    out = rows.where("not is_anchor").join(lead.withColumn("reanalyse", F.col("anchor_id").isNotNull() & brings).hint("merge"), "group_id")
    retry = F.lit(False)
    if retries is not None:
        out = out.join(retries.select("unique_id").distinct().withColumn("_retry", F.lit(True)), "unique_id", "left")
        retry = F.coalesce("_retry", F.lit(False))
    fresh_one = F.col("anchor_id").isNull() & (F.col("first_id") == F.col("unique_id"))
    fate = F.when(fresh_one, "genuinely_new").when(retry, "consumed_retry").otherwise("merged_into_anchor")
    change = F.when(F.col("reanalyse"), F.nullif(F.col("lowest") - F.col("anchor_price"), F.lit(0)))
    return out.select("unique_id", "group_id", "anchor_id", fate.alias("fate"), "reanalyse", change.alias("price_change"))


def resolve_existing(records: DataFrame, images: DataFrame | None = None, children: dict[str, tuple[DataFrame, str]] | None = None, unlinked: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """A whole table resolved against itself: kept (the fused records), absorbed (absorbed, kept),
    and the tables that hang on the records: children lose the rows of absorbed ids, those in
    unlinked have them point to nothing."""
    one = Window.partitionBy("unique_id").orderBy("first_seen")
    rows = records.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    groups = stored(L.group_matches(L.qualifying_pairs(rows, ["outcode", "bedrooms"], images), ["outcode", "bedrooms"]), "groups")
    rows = L.grouped(rows, groups)
    kept = L.fuse(rows, images)
    absorbed = rows.join(groups.select("group_id").distinct().hint("merge"), "group_id", "left_semi").select(F.col("unique_id").alias("absorbed"), "group_id")
    absorbed = absorbed.join(kept.select("group_id", F.col("unique_id").alias("kept")).hint("merge"), "group_id").where("absorbed <> kept").select("absorbed", "kept")
    cascade = U.delete_cascade(records, absorbed.select(F.col("absorbed").alias("unique_id")), "unique_id", children or {}, unlinked or {})
    return {"kept": kept, "absorbed": absorbed} | {k: v for k, v in cascade.items() if k != "parent"}


@dataclass(frozen=True)
class Run:
    """What a run works on. listings and golden are the stored tables; details has unique_id,
    gallery and floorplan; commutes has id, mode and minutes."""

    listings: DataFrame
    golden: DataFrame
    outcodes: DataFrame
    images: DataFrame
    details: DataFrame
    commutes: DataFrame
    criteria: B.Criteria
    most_minutes: int
    exempt: tuple[str, ...] = ("openrent",)
    most_attempts: int = 3
    as_of: Column | None = None


def upserted(scraped: DataFrame, listings: DataFrame) -> DataFrame:
    """The stored listings with the scraped ones (one row for each id) upserted, as a run leaves them."""
    keep = {"first_seen": "keep", "merged_id": "keep", "description": "coalesce_new", "latitude": "coalesce_new", "longitude": "coalesce_new", "postcode": "coalesce_new"}
    return U.merge_upsert(listings, scraped.drop("merged_id") if "merged_id" in scraped.columns else scraped, ["unique_id"], {k: v for k, v in keep.items() if k in listings.columns})


def pipeline_run(raw: DataFrame, run: Run) -> dict[str, DataFrame]:
    """A whole run: listings (the stored ones with the scraped upserted), price_changes (of known
    records that pass criteria and location), seconds (of the jobs up to the commute, and of those
    that resolve and end the records), fates (one row for each scraped record and retry), events (one for each stage that a
    record passed or ended in), funnel (records that passed each stage), and saved (the new golden
    records, waiting for analysis).

    Stages: criteria, location, new (not yet promoted; retries join in here), enriched (details
    with photos or a floor plan), commute, dedup (against recent records), gate (floor plan)."""
    begun = time.monotonic()
    scraped = G.first_rows(raw, ["unique_id"], ["first_seen"])
    listings = upserted(scraped, run.listings)
    # what decides a record's fate; the rest of it waits in the tables
    slim = [c for c in COMPARED if c in scraped.columns]
    known = run.listings.where("merged_id is not null").select("unique_id").distinct().withColumn("_seen", F.lit(True))
    marked = B.with_location(scraped.select(slim), run.outcodes, "_location").withColumns({"_criteria": B.fits(run.criteria), "retry": F.lit(False)})
    marked = marked.join(known, "unique_id", "left").withColumn("_new", F.col("_seen").isNull()).drop("_seen")
    marked = marked.withColumns({c: F.col(c) & F.col("unique_id").isNotNull() for c in ("_criteria", "_location", "_new")})
    waiting = B.queued(run.golden, "unenriched", most=run.most_attempts)
    waiting = waiting.select([c for c in slim if c in waiting.columns])
    again = waiting.join(scraped.select("unique_id"), "unique_id", "left_anti")
    again = again.withColumn("retry", F.lit(True)).withColumns({c: F.lit(True) for c in ("_criteria", "_location", "_new")})
    rows = marked.unionByName(again, allowMissingColumns=True)
    late = waiting.select("unique_id").withColumn("_late", F.lit(True))
    rows = rows.join(late, "unique_id", "left").withColumn("retry", F.col("retry") | F.coalesce("_late", F.lit(False))).drop("_late")
    has = (F.coalesce(F.size("gallery"), F.lit(0)) > 0) | F.col("floorplan").isNotNull()
    rows = rows.join(run.details.select("unique_id", has.alias("_enriched"), F.col("floorplan").isNotNull().alias("_plan")), "unique_id", "left")
    near = G.best_commute(run.commutes, run.most_minutes).select(F.col("id").alias("unique_id"), F.col("minutes").alias("commute_minutes"), "mode")
    rows = rows.join(near, "unique_id", "left").withColumn("_commute", F.col("commute_minutes").isNotNull())
    rows = stored(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_criteria", "_location", "_new", "_enriched", "_commute", "_plan")}), "run")
    filtered = time.monotonic()

    upto = ["_criteria", "_location", "_new", "_enriched", "_commute"]
    through = rows.where(B.every([F.col(c) for c in upto]))
    cols = [c for c in slim if c in run.golden.columns]
    anchors = B.queued(run.golden, "anchors").select(cols).join(through.select("unique_id"), "unique_id", "left_anti")
    fates = resolve_against_anchors(through.select(cols), anchors, images=run.images, as_of=run.as_of, retries=through.where("retry"))
    rows = rows.join(fates, "unique_id", "left")
    allowed = F.col("_plan") | F.col("source").isin(*run.exempt)
    end = F.lit(None).cast("string")
    for c, name in reversed(list(zip(upto, ("rejected_criteria", "rejected_location", "seen", "unenriched", "too_far")))):
        end = F.when(~F.col(c), name).otherwise(end)
    fate = F.coalesce(end, F.when(F.col("fate") != "genuinely_new", F.col("fate")), F.when(allowed, "saved").otherwise("no_floorplan"))
    decided = ["unique_id", "source", "retry", fate.alias("fate"), "anchor_id", "reanalyse", "price_change", "commute_minutes", "price_pcm", "_criteria", "_location"]
    rows = stored(rows.select(decided), "fates")
    seconds = rows.sparkSession.createDataFrame([("filters", filtered - begun), ("resolution", time.monotonic() - filtered)], "stage string, seconds double")
    out = rows.select("unique_id", "source", "retry", "fate", "anchor_id", "reanalyse", "price_change", "commute_minutes")

    stages = ["scraped", "criteria", "location", "new", "enriched", "commute", "dedup", "gate"]
    ended = ["", "rejected_criteria", "rejected_location", "seen", "unenriched", "too_far", "merged_into_anchor", "no_floorplan"]
    place = F.coalesce(F.when(F.col("fate") == "consumed_retry", 6), F.nullif(F.array_position(F.array(*map(F.lit, ended)), F.col("fate")) - 1, F.lit(-1)), F.lit(len(stages))).cast("int")
    steps = out.withColumn("_end", place).select("unique_id", "source", "fate", "_end", F.explode(F.sequence(F.lit(0), F.least(place, F.lit(len(stages) - 1)))).alias("_i"))
    passed = F.col("_i") < F.col("_end")
    events = steps.select("unique_id", "source", F.element_at(F.array(*map(F.lit, stages)), F.col("_i") + 1).alias("stage"), F.when(passed, "passed").otherwise(F.col("fate")).alias("event_type"))
    funnel = events.where("event_type = 'passed'").groupBy("stage").agg(F.count("*").alias("n"))

    before = run.golden.select("unique_id", F.col("price_pcm").alias("old_price"))
    # of those that pass the first two filters; retries that were not scraped have the price they had
    changes = rows.where("_criteria and _location").join(before, "unique_id").where("old_price <> price_pcm").select("unique_id", "old_price", F.col("price_pcm").alias("new_price"), (F.col("price_pcm") - F.col("old_price")).alias("change"))
    saved = G.wrap_single(scraped.join(out.where("fate = 'saved'").select("unique_id"), "unique_id", "left_semi")).withColumn("notification_status", F.lit("pending_analysis"))
    return {"listings": listings, "price_changes": changes, "fates": out, "events": events, "funnel": funnel, "saved": saved, "seconds": seconds}


def check_list(golden: DataFrame, listings: DataFrame) -> DataFrame:
    """What to look at for each record, as golden_id, pos, source, url: its listings (by source),
    then the sources that only its source_urls name, then its own URL if it has neither."""
    own = listings.where("merged_id is not null").select(F.col("merged_id").alias("golden_id"), "source", "url", F.lit(1).alias("way")).join(golden.select("golden_id"), "golden_id", "left_semi")
    named = golden.select("golden_id", F.explode(F.map_entries("source_urls")).alias("e")).select("golden_id", F.col("e.key").alias("source"), F.col("e.value").alias("url"), F.lit(2).alias("way")).where("url <> ''")
    rest = golden.select("golden_id", "source", "url", F.lit(3).alias("way"))
    first = G.first_rows(own.union(named), ["golden_id", "source"], ["way", "url"])
    alone = rest.join(first.select("golden_id").distinct(), "golden_id", "left_anti")
    w = Window.partitionBy("golden_id").orderBy("way", "source")
    return first.union(alone).withColumn("pos", F.row_number().over(w)).select("golden_id", "pos", "source", "url")


def off_market_job(golden: DataFrame, listings: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses (url, status) of what check_list names -> the records that changed (id, off,
    returned, reason), and the listings with is_off_market and the reason as last seen. What was
    not looked at is unknown."""
    checked = check_list(golden, listings).join(responses.select("url", "status"), "url", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    checks = checked.join(golden.select("golden_id", "is_off_market"), "golden_id").select(F.col("golden_id").alias("id"), "pos", "status", F.col("is_off_market").alias("was_off"))
    last = responses.where("status <> 'unknown'").select("url", (F.col("status") != "active").alias("_off"), "status")
    rows = listings.join(last, "url", "left").withColumns({"is_off_market": F.coalesce("_off", "is_off_market"), "off_market_reason": F.when(F.col("_off"), F.col("status"))})
    return G.derive_off_market(checks).where("off or returned"), rows.drop("_off", "status")


def price_change_job(obs: DataFrame, analyses: DataFrame, key: str = "entity") -> DataFrame:
    """analyses (key, average, value, adjusted, told, and what fit_score reads) of the listings
    whose price changed, as rows to upsert: the rule's rating for the latest price, no adjusted
    rating, the fit that follows, and the listing due for a notice again; with the change."""
    last = H.price_changes(obs, key).groupBy(key).agg(F.max_by(F.struct("old_price", "new_price", "change"), F.struct("ts", "obs_id")).alias("c")).select(key, "c.*")
    rows = S.merge_analysis(last.join(analyses, key), F.lit(True), F.col("new_price"), F.col("average"))
    return rows.withColumn("told", F.lit(False))


def evaluate_matcher(pairs: DataFrame, labels: DataFrame, signals: list[str], low: int = 0, high: int = 160, step: int = 5) -> dict[str, DataFrame]:
    """Scored pairs (pair_id, score, is_match, s_<signal>) against sure labels (pair_id, label):
    metrics, signals (how often each fires in true and false matches), sweep (metrics at each
    threshold), errors (wrong pairs), and missing (labels without a pair)."""
    known, missing = J.labels_join(labels, pairs)
    truth = (F.col("label") == "match").alias("truth")
    known = stored(known.select("pair_id", truth, "score", "is_match", *(f"s_{x}" for x in signals)), "labelled")
    out = evaluate_labelled(known.withColumn("scorer", F.lit("")), {"": ("score", "is_match")}, signals, low, high, step)
    return {k: df.drop("scorer") for k, df in out.items()} | {"missing": missing}


def evaluate_labelled(known: DataFrame, scorers: dict[str, tuple[str, str]], signals: list[str], low: int = 0, high: int = 160, step: int = 5) -> dict[str, DataFrame]:
    """Pairs that bear their label (pair_id, truth, s_<signal>) and what scorers say of them (name ->
    columns of score and match): metrics, signals, sweep and errors, each with the scorer. Scores count
    as rounded to four places, which is done only where a threshold (a multiple of step) is near. Pairs are
    read twice, once to be counted for all scorers and once for the errors; they are neither kept
    nor shuffled."""
    flags = {"truth": F.col("truth")} | {f"s_{x}": (F.col(f"s_{x}") > 0).cast("double") for x in signals} | {m: F.col(m) for _, m in scorers.values()}
    exact = lambda x: F.when(F.abs(x - F.rint(x / step) * step) < 0.001, F.round(x, 4)).otherwise(x)
    counts = stored(M.tally(known, flags, {s: exact(F.col(s)) for s, _ in scorers.values()}, low, high, step), "tally")
    truth, n, out = F.col("truth"), F.col("n"), {}
    for name, (score, match) in scorers.items():
        rows = counts.withColumn("score", F.col(score))
        parts = {
            "metrics": M.confusion(rows, F.col(match), truth, count=n),
            "signals": M.signal_firing(rows, [f"s_{x}" for x in signals], F.col(match), truth, n),
            "sweep": M.threshold_sweep(rows, truth, low, high, step, n),
        }
        for k, df in parts.items():
            df = df.withColumn("scorer", F.lit(name))
            out[k] = out[k].union(df) if k in out else df
    wrong = [F.when(F.col(m) != truth, F.struct(F.lit(name).alias("scorer"), F.round(s, 4).alias("score"), F.when(F.col(m), "false_positive").otherwise("false_negative").alias("kind"))) for name, (s, m) in scorers.items()]
    any_ = reduce(lambda x, y: x | y, [F.coalesce(F.col(m) != truth, F.lit(False)) for _, m in scorers.values()])
    out["errors"] = known.where(any_).select("pair_id", F.explode(F.array_compact(F.array(*wrong))).alias("e")).select("pair_id", "e.score", "e.kind", "e.scorer")
    return out


def false_merge_audit(images: DataFrame, least: int = 3) -> DataFrame:
    """group_id whose sources have `least` photos each on two sides and none alike."""
    g = images.where("image_type = 'gallery'").groupBy("group_id", "source").agg(F.array_sort(F.collect_list(F.struct("image_id", "phash")))["phash"].alias("h")).where(F.size("h") >= least)
    b = g.select("group_id", F.col("source").alias("other"), F.col("h").alias("g"))
    pairs = g.join(b, "group_id").where("source < other").withColumn("matches", L.gallery_match_count(F.col("h"), F.col("g")))
    return pairs.groupBy("group_id").agg(F.count("*").alias("source_pairs"), F.bool_or(F.col("matches") == 0).alias("suspicious"))
