"""Scores of a listing: value, fit, icons, full cost, negotiation.

Fit rules are kept as tables of SQL conditions and points, which are compiled to one expression
for each dimension; users may pass tables of their own.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The fields of an analysis document that rules and searches read: column -> path.
FIELDS = {
    "rating": "overall_rating", "concern": "condition_concerns", "severity": "concern_severity", "hob": "kitchen.hob_type", "kitchen": "kitchen.overall_quality",
    "dishwasher": "kitchen.has_dishwasher", "washer": "kitchen.has_washing_machine", "light": "light_space.natural_light", "windows": "light_space.window_sizes",
    "ceiling": "light_space.ceiling_height", "floor": "light_space.floor_level", "airy": "light_space.feels_spacious", "living": "space.living_room_sqm",
    "total": "space.total_area_sqm", "spacious": "space.is_spacious_enough", "layout": "space.hosting_layout", "value": "value.rating",
    "adjusted": "value.quality_adjusted_rating", "desk": "bedroom.can_fit_desk", "office": "bedroom.office_separation", "balcony": "outdoor_space.has_balcony",
    "garden": "outdoor_space.has_garden", "terrace": "outdoor_space.has_terrace", "shared_garden": "outdoor_space.has_shared_garden", "flooring": "flooring_noise.primary_flooring",
    "glazing": "flooring_noise.has_double_glazing", "walls": "flooring_noise.building_construction", "risk": "flooring_noise.hosting_noise_risk", "noises": "flooring_noise.noise_indicators",
    "epc": "listing_extraction.epc_rating", "pets": "listing_extraction.pets_allowed", "band": "listing_extraction.council_tax_band", "kind": "listing_extraction.property_type",
    "broadband": "listing_extraction.broadband_type", "bills": "listing_extraction.bills_included", "service": "listing_extraction.service_charge_pcm", "tags_up": "highlights", "tags_down": "lowlights",
    "red_flags": "listing_red_flags.red_flag_count",
}


def unpack(df: DataFrame, doc: str = "doc") -> DataFrame:
    """One text column for each field; a missing or null field is null. An unreadable document
    gives nulls. The document is parsed once, against a schema of the fields in use (Spark prunes
    the others); numbers, truth values and lists come as their JSON text."""
    parts: dict[str, list[str]] = {}
    for path in FIELDS.values():
        head, _, leaf = path.partition(".")
        parts.setdefault(head, []).append(leaf)
    schema = ", ".join(f"{head} struct<{', '.join(f'{x}: string' for x in leaves)}>" if leaves != [""] else f"{head} string" for head, leaves in parts.items())
    df = df.withColumn("_fields", F.from_json(doc, schema))
    return df.withColumns({name: F.col(f"_fields.{path}") for name, path in FIELDS.items()}).drop("_fields")


def _known(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} <> 'unknown')"


def _lookup(c: str, points: dict[str, float]) -> tuple[str, str]:
    return _known(c), "CASE " + " ".join(f"WHEN {c} = '{v}' THEN {p}" for v, p in points.items()) + " ELSE 0 END"


def _clamp(x: str, hi: float) -> str:
    return f"greatest(0, least({hi}, {x}))"


_OUTDOOR = "(balcony = 'true' OR garden = 'true' OR terrace = 'true' OR shared_garden = 'true')"
_ANY_OUT = "(balcony IS NOT NULL OR garden IS NOT NULL OR terrace IS NOT NULL OR shared_garden IS NOT NULL)"
_NUM = "CAST({} AS DOUBLE)"
LIVING, TOTAL, RATING = (_NUM.format(c) for c in ("living", "total", "rating"))

# Fixed values: (condition under which the rule counts as a signal, points).
WORKSPACE = [
    ("bedrooms >= 2 OR bedrooms = 0", "CASE WHEN bedrooms >= 2 THEN 35 ELSE 0 END"),
    ("desk IN ('yes', 'no')", "CASE WHEN desk = 'yes' THEN 25 ELSE 0 END"),
    ("office IN ('dedicated_room', 'separate_area', 'shared_space', 'none')", "CASE office WHEN 'dedicated_room' THEN 40 WHEN 'separate_area' THEN 25 WHEN 'shared_space' THEN 10 ELSE 0 END"),
    ("spacious IS NOT NULL", "CASE WHEN spacious = 'true' AND bedrooms <= 1 THEN 40 ELSE 0 END"),
    ("broadband IN ('fttp', 'cable', 'fttc')", "CASE broadband WHEN 'fttp' THEN 15 WHEN 'cable' THEN 10 WHEN 'fttc' THEN 8 ELSE 0 END"),
]
HOSTING = [
    ("spacious = 'true' OR (spacious = 'false' AND bedrooms >= 2)", "CASE WHEN spacious = 'true' THEN 25 WHEN spacious = 'false' AND bedrooms >= 2 THEN 15 ELSE 0 END"),
    (f"{LIVING} > 0", f"CASE WHEN {LIVING} > 0 THEN {_clamp(f'({LIVING} - 10) * 2', 30)} ELSE 0 END"),
    (f"{TOTAL} > 0", f"CASE WHEN {TOTAL} > 0 THEN {_clamp(f'({TOTAL} - 30) * 0.6', 15)} ELSE 0 END"),
    ("airy IS NOT NULL", "CASE WHEN airy = 'true' THEN 10 ELSE 0 END"),
    (_ANY_OUT, f"CASE WHEN {_OUTDOOR} THEN 15 ELSE 0 END"),
    _lookup("layout", {"excellent": 25, "good": 15}),
    ("risk = 'low'", "CASE WHEN risk = 'low' THEN 10 ELSE 0 END"),
    ("tolerance IN ('high', 'moderate', 'low')", "CASE tolerance WHEN 'high' THEN 10 WHEN 'low' THEN -10 ELSE 0 END"),
]
SOUND = [
    _lookup("walls", {"solid_brick": 35, "concrete": 35}),
    ("glazing IN ('yes', 'no')", "CASE WHEN glazing = 'yes' THEN 25 ELSE 0 END"),
    _lookup("floor", {"top": 20}),
    ("noises IS NOT NULL", "CASE WHEN noises = '[]' THEN 10 ELSE 0 END"),
    ("kind = 'warehouse'", "CASE WHEN kind = 'warehouse' THEN 10 ELSE 0 END"),
    _lookup("risk", {"low": 20, "moderate": 8}),
]
KITCHEN = [
    _lookup("hob", {"gas": 35, "induction": 35}),
    _lookup("kitchen", {"modern": 30, "decent": 15}),
    ("dishwasher IN ('yes', 'no')", "CASE WHEN dishwasher = 'yes' THEN 15 ELSE 0 END"),
    ("washer IN ('yes', 'no')", "CASE WHEN washer = 'yes' THEN 10 ELSE 0 END"),
]
CONDITION = [
    (f"{RATING} BETWEEN 1 AND 5", f"CASE WHEN {RATING} BETWEEN 1 AND 5 THEN ({RATING} - 1) * 25 ELSE 50 END"),
    ("concern = 'true'", "CASE WHEN concern = 'true' THEN CASE severity WHEN 'serious' THEN -30 WHEN 'moderate' THEN -15 WHEN 'minor' THEN -5 ELSE 0 END ELSE 0 END"),
    (_known("coalesce(adjusted, value)"), "CASE coalesce(adjusted, value) WHEN 'excellent' THEN 10 WHEN 'good' THEN 5 ELSE 0 END"),
]
TAGS = {"Period features": 10, "Open-plan layout": 6, "Floor-to-ceiling windows": 8, "Spacious living room": 4, "Canal views": 6, "Park views": 4, "Roof terrace": 6, "Recently refurbished": 3}
TAGS_DOWN = {"Needs updating": -8, "Compact living room": -4, "Small living room": -4}
_HAS = "coalesce({} LIKE '%\"{}\"%', FALSE)"
_VIEWS = f"least(8, CASE WHEN {_HAS.format('tags_up', 'Canal views')} THEN 6 ELSE 0 END + CASE WHEN {_HAS.format('tags_up', 'Park views')} THEN 6 ELSE 0 END)"
_TAGSUM = " + ".join([f"CASE WHEN {_HAS.format('tags_up', t)} THEN {p} ELSE 0 END" for t, p in TAGS.items()] + [f"CASE WHEN {_HAS.format('tags_down', t)} THEN {p} ELSE 0 END" for t, p in TAGS_DOWN.items()])
_ANYTAG = " OR ".join([_HAS.format("tags_up", t) for t in TAGS] + [_HAS.format("tags_down", t) for t in TAGS_DOWN])
VIBE = [  # six clusters
    ("kind IN ('warehouse', 'period_conversion', 'victorian', 'edwardian', 'georgian')", "CASE WHEN kind = 'warehouse' THEN 35 WHEN kind = 'period_conversion' THEN 28 WHEN kind IN ('victorian', 'edwardian', 'georgian') THEN 20 ELSE 0 END"),
    (f"{_known('light')} OR {_known('windows')} OR {_known('ceiling')} OR airy = 'true'", "CASE light WHEN 'excellent' THEN 15 WHEN 'good' THEN 8 ELSE 0 END + CASE WHEN windows = 'large' THEN 10 ELSE 0 END + CASE ceiling WHEN 'high' THEN 10 WHEN 'low' THEN -5 ELSE 0 END + CASE WHEN airy = 'true' THEN 5 ELSE 0 END"),
    (f"{_known('flooring')} OR {_known('walls')}", "CASE flooring WHEN 'hardwood' THEN 12 WHEN 'tile' THEN 6 WHEN 'mixed' THEN 4 ELSE 0 END + CASE walls WHEN 'solid_brick' THEN 8 WHEN 'concrete' THEN 4 WHEN 'timber_frame' THEN -3 ELSE 0 END"),
    (f"{_known('floor')} OR {_HAS.format('tags_up', 'Canal views')} OR {_HAS.format('tags_up', 'Park views')}", f"CASE floor WHEN 'top' THEN 10 WHEN 'upper' THEN 6 WHEN 'ground' THEN 2 WHEN 'basement' THEN -5 ELSE 0 END + {_VIEWS}"),
    (_known("layout"), "CASE layout WHEN 'excellent' THEN 12 WHEN 'good' THEN 8 WHEN 'poor' THEN -3 ELSE 0 END"),
    (_ANYTAG, f"least(20, {_TAGSUM})"),
]
DIMENSIONS = {"workspace": (25, 0.5, WORKSPACE), "hosting": (20, 0.4, HOSTING), "sound": (15, 0.35, SOUND), "kitchen_fit": (15, 0.4, KITCHEN), "vibe": (15, None, VIBE), "condition": (10, 0.5, CONDITION)}
VIBE_CONFIDENCE = {0: 0.0, 1: 0.25, 2: 0.5, 3: 0.7}
TIERS = {"excellent": 80, "good": 60, "fair": 40, "poor": 0}


def fit_parts(dimensions: dict = DIMENSIONS) -> dict[str, str]:
    """SQL for <name>_score (0 to 100) and <name>_conf (0 to 1) of each dimension."""
    out = {}
    for name, (_, each, rules) in dimensions.items():
        signals = " + ".join(f"CASE WHEN {s} THEN 1 ELSE 0 END" for s, _ in rules)
        points = " + ".join(f"({p})" for _, p in rules)
        out[f"{name}_score"] = f"greatest(0e0, least(100e0, CAST({points} AS DOUBLE)))"
        steps = " ".join(f"WHEN {n} THEN {c}" for n, c in VIBE_CONFIDENCE.items())
        conf = f"least(1e0, {each} * ({signals}))" if each else f"CASE {signals} {steps} ELSE 1 END"
        out[f"{name}_conf"] = f"CAST({conf} AS DOUBLE)"
    return out


def fit_total(dimensions: dict = DIMENSIONS) -> tuple[str, str]:
    top = " + ".join(f"{w} * {n}_score * {n}_conf" for n, (w, _, _) in dimensions.items())
    base = " + ".join(f"{w} * {n}_conf" for n, (w, _, _) in dimensions.items())
    return top, base


def fit_score(df: DataFrame, dimensions: dict = DIMENSIONS) -> DataFrame:
    """df (unpacked, with bedrooms and tolerance) with the dimensions, fit and tier; fit is null
    if no dimension has a signal."""
    df = df.withColumns({n: F.expr(x) for n, x in fit_parts(dimensions).items()})
    top, base = (F.expr(x) for x in fit_total(dimensions))
    df = df.withColumn("fit", F.when(base > 0, F.bround(top / base).cast("int")))
    tier = F.when(F.col("fit").isNull(), None)
    for name, least in TIERS.items():
        tier = tier.when(F.col("fit") >= least, name)
    return df.withColumn("tier", tier)


# What each side of a home shows, as (condition, state, tooltip) in order of precedence;
# the last holds where none else does.
ICONS: dict[str, list[tuple[str, str, str]]] = {
    "workspace": [
        ("office = 'dedicated_room'", "good", "Dedicated office room"),
        ("office = 'separate_area'", "good", "Separate work area"),
        ("office = 'shared_space' AND bedrooms >= 2", "neutral", "2-bed but office in shared space"),
        ("office = 'shared_space'", "concern", "Desk in shared space — no separation"),
        ("office = 'none'", "concern", "No viable workspace"),
        ("bedrooms >= 2", "good", "2+ beds — dedicated office possible"),
        ("desk = 'yes'", "good", "Can fit desk in bedroom"),
        ("bedrooms = 1 AND spacious = 'true'", "good", "Spacious 1-bed — desk space likely"),
        ("bedrooms = 0", "concern", "Studio — no office separation"),
        ("bedrooms = 1 AND spacious = 'false'", "concern", "Compact 1-bed — limited desk space"),
        ("true", "neutral", "Workspace potential unclear"),
    ],
    "hosting": [
        ("spacious = 'true' AND (walls IN ('solid_brick', 'concrete') OR glazing = 'yes')", "good", "Spacious + good sound insulation"),
        ("spacious = 'false' AND noises <> '[]'", "concern", "Compact space + noise concerns"),
        ("spacious = 'false' AND bedrooms >= 2", "neutral", "2-bed — compact but size less critical"),
        ("spacious = 'false'", "concern", "Compact — limited hosting space"),
        ("spacious = 'true'", "neutral", "Spacious but sound insulation unknown"),
        ("true", "neutral", "Hosting suitability unclear"),
    ],
    "kitchen": [
        ("hob IN ('gas', 'induction') AND kitchen IN ('modern', 'decent')", "good", "{hob} hob, {kitchen} kitchen"),
        ("hob IN ('gas', 'induction')", "good", "{hob} hob"),
        ("hob = 'electric' AND kitchen = 'dated'", "concern", "Electric hob, dated kitchen"),
        ("hob = 'electric'", "concern", "Electric hob"),
        ("kitchen = 'dated'", "concern", "Dated kitchen"),
        ("kitchen IN ('modern', 'decent')", "neutral", "{Kitchen} kitchen, hob type unknown"),
        ("true", "neutral", "Kitchen details unclear"),
    ],
    "vibe": [
        ("kind IN ('warehouse', 'period_conversion', 'victorian', 'edwardian', 'georgian')", "good", "{kind} — character property"),
        ("lower(tags_up) RLIKE 'period|character|original|warehouse|conversion|high ceiling|exposed'", "good", "Character features noted"),
        ("kind IN ('new_build', 'purpose_built')", "neutral", "{kind}"),
        ("true", "neutral", "Style unclear"),
    ],
    "space": [
        (f"spacious = 'true' AND {_OUTDOOR}", "good", "Spacious with outdoor space"),
        ("spacious = 'true'", "good", "Spacious layout"),
        ("spacious = 'false' AND bedrooms >= 2", "neutral", "2-bed — size less critical"),
        ("spacious = 'false'", "concern", "Not spacious enough"),
        (_OUTDOOR, "neutral", "Has outdoor space, size unclear"),
        ("true", "neutral", "Space unclear"),
    ],
    "internet": [
        ("broadband = 'fttp'", "good", "Full fibre (FTTP) available"),
        ("broadband = 'fttc'", "neutral", "Superfast broadband (FTTC)"),
        ("broadband = 'cable'", "neutral", "Cable broadband"),
        ("broadband = 'standard'", "concern", "Basic broadband only"),
        ("true", "neutral", "Broadband not mentioned"),
    ],
}
#: What stands for a name in braces in a tooltip.
_SHOWN = {"hob": "initcap(hob)", "kitchen": "kitchen", "Kitchen": "initcap(kitchen)", "kind": "initcap(replace(kind, '_', ' '))"}


def lifestyle_icons(df: DataFrame) -> DataFrame:
    """icon_ (good, neutral or concern) and tip_ (why) for six sides of a home, and has_outdoor."""
    out: dict[str, Column] = {"has_outdoor": F.coalesce(F.expr(_OUTDOOR), F.lit(False))}
    for side, rules in ICONS.items():
        states = [(F.expr(when), state) for when, state, _ in rules]
        tips = [(F.expr(when), _tooltip(tip)) for when, _, tip in rules]
        out |= {f"icon_{side}": _ladder(states, None), f"tip_{side}": _ladder(tips, None)}
    return df.withColumns(out)


def _tooltip(text: str) -> Column:
    parts = re.split(r"\{(\w+)\}", text)  # every second one is a name
    return F.concat(*(F.expr(_SHOWN[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def _ladder(arms, other: str | None) -> Column:
    out = F.when(F.lit(False), "")
    for cond, value in arms:
        out = out.when(F.coalesce(cond, F.lit(False)), value)
    return out.otherwise(other)


def assess_value(df: DataFrame, benchmarks: DataFrame, defaults: DataFrame) -> DataFrame:
    """Price against the benchmark of the outcode (first word of the postcode) for 1 to 3 bedrooms,
    else the default row: average, difference, value_rating and value_note."""
    df = df.withColumns({"_o": F.upper(F.split(F.trim("postcode"), r"\s+")[0]), "_b": F.greatest(F.least(F.col("bedrooms"), F.lit(3)), F.lit(1))})
    known = benchmarks.select(F.col("outcode").alias("_o")).distinct().withColumn("_has", F.lit(True))
    own = benchmarks.select(F.col("outcode").alias("_o"), F.col("bedrooms").alias("_b"), F.col("median").alias("_m"))
    other = defaults.select(F.col("bedrooms").alias("_b"), F.col("median").alias("_d"))
    df = df.join(known, "_o", "left").join(own, ["_o", "_b"], "left").join(other, "_b", "left")
    df = df.withColumn("average", F.when(F.col("_has"), F.col("_m")).otherwise(F.col("_d"))).withColumn("difference", F.col("price_pcm") - F.col("average"))
    pct = F.col("difference") / F.col("average") * 100
    rating = F.when(pct <= -10, "excellent").when(pct <= 0, "good").when(pct <= 10, "fair").when(pct.isNotNull(), "poor")
    money = F.format_number(F.abs("difference"), 0)
    side = F.when(F.col("difference") < 0, "below").otherwise("above")
    note = F.when(F.col("difference") == 0, F.concat(F.lit("At "), "_o", F.lit(" average"))).otherwise(F.concat(F.lit("£"), money, F.lit(" "), side, F.lit(" "), "_o", F.lit(" average")))
    return df.withColumns({"value_rating": rating, "value_note": note}).drop("_o", "_b", "_has", "_m", "_d")


def true_cost(df: DataFrame, tax: DataFrame, energy: DataFrame, water: DataFrame, broadband: DataFrame, service: DataFrame) -> DataFrame:
    """df (price_pcm, bedrooms, borough, band, epc, broadband, bills, service, kind) with the full
    monthly cost. Unknown tax is left out; bills included leave out energy, water and broadband."""
    key = F.greatest(F.lit(1), F.least(F.lit(2), F.col("bedrooms")))
    df = df.withColumns({"_k": key, "_epc": F.coalesce(F.upper("epc"), F.lit("D")), "_bb": F.coalesce(F.when(F.col("broadband") != "unknown", F.col("broadband")), F.lit("fttp"))})
    df = df.join(tax.select("borough", "band", F.col("amount").alias("tax")), ["borough", "band"], "left")
    df = df.join(energy.select(F.col("epc").alias("_epc"), F.col("beds").alias("_k"), F.col("amount").alias("_en")), ["_epc", "_k"], "left")
    df = df.join(water.select(F.col("beds").alias("_k"), F.col("amount").alias("_wa")), "_k", "left").join(broadband.select(F.col("type").alias("_bb"), F.col("amount").alias("_br")), "_bb", "left")
    df = df.join(service.select(F.col("kind"), F.col("low").alias("_lo"), F.col("high").alias("_hi")), "kind", "left")
    bills = F.coalesce(F.col("bills") == "yes", F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    charge = F.col("service").cast("int")
    base = F.col("price_pcm") + zero("tax") + F.when(bills, 0).otherwise(zero("_en") + zero("_wa") + zero("_br"))
    low = base + F.coalesce(charge, F.col("_lo"), F.lit(0))
    out = df.withColumns({"total": low, "total_high": base + F.coalesce(charge, F.col("_hi"), F.lit(0))})
    return out.withColumn("rent_pct", F.bround(F.col("price_pcm") / F.col("total") * 100).cast("int")).drop("_k", "_epc", "_bb", "_en", "_wa", "_br", "_lo", "_hi")


def negotiation(df: DataFrame, as_of: Column) -> DataFrame:
    """df (days, n_drops, sum_drops, price_pcm, median, direction, yoy) with five signals, net and
    strength. A signal is a weight, positive for the buyer's side and negative for the seller's."""
    d, c = F.col("days"), F.col
    week = lambda base, per, at: F.bround(base + per * (d - at) / 7, 2)
    days = F.when(d >= 28, 1.0).when(d >= 21, week(0.6, 0.4, 21)).when(d >= 14, week(0.4, 0.2, 14)).when(d >= 7, week(0.2, 0.2, 7)).when(d > 0, -0.2).otherwise(-0.3)
    drops = F.when(c("n_drops") > 0, F.bround(F.least(F.lit(1.0), 0.3 + 0.2 * (c("n_drops") - 1) + 0.1 * (F.abs("sum_drops") / 100)), 2)).otherwise(0.0)
    pct = (c("price_pcm") - c("median")) / c("median") * 100
    level = F.when(F.abs(pct) <= 5, 0.0).when(F.abs(pct) <= 15, F.bround(0.3 + 0.7 * (F.abs(pct) - 5) / 10, 2)).otherwise(1.0)
    bench = F.when(c("median").isNull() | (c("price_pcm") <= 0), 0.0).otherwise(level * F.signum(pct))
    trend = F.when(c("yoy").isNull(), 0.0).when((c("direction") == "rising strongly") | (c("yoy") >= 7), -0.6).when((c("direction") == "rising") | (c("yoy") >= 3), -0.3).when(c("direction").isin("falling", "declining") | (c("yoy") < 0), 0.5).otherwise(0.2)
    month = F.month(as_of)
    season = F.when(month.isin(11, 12, 1, 2), 0.3).when(month.between(6, 9), -0.3).otherwise(0.0)
    df = df.withColumns({"w_days": days, "w_drops": drops, "w_benchmark": bench, "w_trend": trend, "w_season": season})
    net = F.round(sum((c(x) for x in ("w_days", "w_drops", "w_benchmark", "w_trend", "w_season")), F.lit(0.0)), 6)
    strength = F.when(net >= 1.5, "strong").when(net >= 0.5, "moderate").when(net >= -0.5, "balanced").otherwise("limited")
    named = F.array(*[F.struct((-F.abs(x)).alias("w"), F.lit(i).alias("i"), F.lit(x[2:]).alias("n"), F.signum(x).alias("s")) for i, x in enumerate(("w_days", "w_drops", "w_benchmark", "w_trend", "w_season"))])
    top = lambda sign: F.array_join(F.transform(F.slice(F.array_sort(F.filter(named, lambda s: s["s"] == sign)), 1, 2), lambda s: s["n"]), ",")
    return df.withColumns({"net": net, "strength": strength, "top_buyer": top(1), "top_seller": top(-1)})


def coerce_enum(c: Column, vocab: list[str], default: str) -> Column:
    return F.when(c.isin(vocab), c).otherwise(default)


def tri_state(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("true", "yes"), "yes").when(low.isin("false", "no"), "no").otherwise("unknown")


def severity(c: Column) -> Column:
    """A missing severity, and one outside the vocabulary, is none."""
    return F.when(c.isin("minor", "moderate", "serious", "none"), c).otherwise("none")


def mend_json(text: Column) -> Column:
    """Control characters (but tab and line ends) and trailing commas taken out."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(plain, r",\s*([}\]])", "$1")


def _tidy(value):
    """Texts that hold an object or a list are read, texts trimmed, empty list items dropped."""
    if isinstance(value, dict):
        return {k: _tidy(v) for k, v in value.items()}
    if isinstance(value, list):
        return [x for x in map(_tidy, value) if not (isinstance(x, str) and x in ("", ","))]
    if not isinstance(value, str):
        return value
    text = value.strip()
    if text[:1] + text[-1:] in ("{}", "[]"):
        for t in (text, re.sub(r",\s*([}\]])", r"\1", text)):
            try:
                return _tidy(json.loads(t))
            except ValueError:
                continue
    return text


@pandas_udf(StringType())
def _tidied(docs: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(_tidy(json.loads(d)), ensure_ascii=False, separators=(",", ":")) if d else None for d in docs], dtype="object")


def clean_documents(df: DataFrame, doc: str = "doc") -> DataFrame:
    """df with the document, mended if it cannot be read as it is (what JSON text inside it holds
    becomes part of it, junk list items go), and rejected, true where it cannot be read even then;
    it is null there, as where it was null."""
    fixed = F.when(F.try_parse_json(F.col(doc)).isNotNull(), F.col(doc)).otherwise(mend_json(F.col(doc)))
    usable = F.try_parse_json(fixed).isNotNull()
    out = df.withColumn("_fixed", F.when(usable, fixed)).withColumn("rejected", F.col(doc).isNotNull() & ~F.coalesce(usable, F.lit(False)))
    return out.withColumn(doc, _tidied("_fixed")).drop("_fixed")


# The tags that an analysis may give.
HIGHLIGHTS = (
    "Gas hob", "Induction hob", "Dishwasher included", "Washing machine", "Modern kitchen", "Modern bathroom", "Two bathrooms", "Ensuite bathroom", "Excellent natural light", "Good natural light",
    "Floor-to-ceiling windows", "High ceilings", "Spacious living room", "Open-plan layout", "Built-in wardrobes", "Good storage", "Private balcony", "Private garden", "Private terrace", "Shared garden",
    "Communal gardens", "Roof terrace", "Excellent condition", "Recently refurbished", "Period features", "Double glazing", "On-site gym", "Concierge", "Bike storage", "Parking included",
    "Pets allowed", "Bills included", "Canal views", "Park views", "Ultrafast broadband (FTTP)", "Dedicated office room", "Separate work area", "Great hosting layout",
)
LOWLIGHTS = (
    "No dishwasher", "No washing machine", "Dated kitchen", "Electric hob", "Compact living room", "Small living room", "Small bedroom", "Compact bedroom", "Poor storage", "No built-in wardrobes",
    "No storage", "Dated bathroom", "No outdoor space", "No interior photos", "No bathroom photos", "Missing key photos", "Potential traffic noise", "New-build acoustics", "Service charge unstated",
    "Balcony cracking", "Needs updating", "Basic broadband only", "No work-life separation", "Poor hosting layout",
)


def known_tags(tags: Column, vocab: tuple[str, ...] = HIGHLIGHTS) -> Column:
    """A JSON array's items that are in the vocabulary, in order."""
    return F.filter(clean_tags(tags), lambda x: x.isin(*vocab))


def one_line(text: Column) -> Column:
    """A summary that came wrapped in an object: its only value, or the one named one_line."""
    values = F.from_json(text, "map<string,string>")
    only = F.when(F.size(values) == 1, F.element_at(F.map_values(values), 1)).otherwise(F.try_element_at(values, F.lit("one_line")))
    return F.when(F.trim(text).startswith("{"), F.coalesce(only, text)).otherwise(text)


def to_bool(c: Column) -> Column:
    """A text that stands for a truth value; anything missing or unknown is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "yes", "1"), F.lit(False))


def denormalise(df: DataFrame) -> DataFrame:
    """Columns that searches filter by, from an unpacked document."""
    outdoor = F.when(F.expr(_ANY_OUT), F.coalesce(F.expr(_OUTDOOR), F.lit(False)))
    return df.withColumns({"has_outdoor_space": outdoor, "red_flag_count": F.coalesce(F.col("red_flags").cast("int"), F.lit(0)), "epc_rating": F.upper("epc")})


def rule_rating(price: Column, average: Column) -> Column:
    pct = (price - average) / average * 100
    return F.when(pct <= -10, "excellent").when(pct <= 0, "good").when(pct <= 10, "fair").when(pct.isNotNull(), "poor")


def merge_analysis(df: DataFrame, changed: Column, price: Column, average: Column) -> DataFrame:
    """The rule's rating beside the adjusted one; where the price changed the rule is applied anew
    and the adjusted rating, which was made for the old price, is dropped. fit and tier follow the
    ratings (df as fit_score takes it)."""
    out = df.withColumns({"value": F.when(changed, rule_rating(price, average)).otherwise(F.col("value")), "adjusted": F.when(~changed, F.col("adjusted"))})
    return fit_score(out)


def clean_tags(c: Column) -> Column:
    """Tags of a JSON array without empty items and stray commas; text items only."""
    return F.filter(F.from_json(c, "array<string>"), lambda x: ~F.trim(x).isin("", ","))


def card_projection(df: DataFrame, first_images: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows in the shape of a card: rating, tags, estimated floor area, first photo, last change."""
    area = F.bround(F.coalesce(F.col("floor_area_sqm"), F.col("total").cast("double")), 1)
    out = df.join(first_images.select("unique_id", F.col("url").alias("first_photo")), "unique_id", "left").join(changes, "unique_id", "left")
    source = F.when(F.col("floor_area_sqm").isNull() & F.col("total").isNotNull(), "estimated")
    return out.select("unique_id", "price_pcm", "bedrooms", "overall_rating", F.array_join(clean_tags(F.col("tags_up")), "|").alias("highlights"), area.alias("area_sqm"), source.alias("area_source"), F.coalesce("image_url", "first_photo").alias("photo"), "last_change")
