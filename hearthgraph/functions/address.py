"""Postcodes, outcodes and street names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
OUTCODE = r"[A-Z]{1,2}\d{1,2}[A-Z]?"
FULL_POSTCODE = r"^[A-Z]{1,2}[0-9][0-9A-Z]?\s+[0-9][A-Z]{2}$"
POSTCODE_IN_TEXT = r"\b([A-Z]{1,2}\d{1,2}[A-Z]?)\s*(\d[A-Z]{2})?\b"
STREET_WORDS = "street road avenue lane drive court place square green gardens terrace crescent close mews park way hill rise grove walk".split()
ABBREVIATIONS = {"st": "street", "rd": "road", "ave": "avenue", "ln": "lane", "dr": "drive", "ct": "court", "pl": "place", "sq": "square", "grn": "green", "gdns?": "gardens", "terr?": "terrace", "cres": "crescent", "clse?": "close", "pk": "park"}
PLACES = ["london", "hackney", "islington", "tower hamlets", "haringey", "camden", "lambeth", "southwark", "lewisham", "greenwich", "newham", "waltham forest"]


def normalize_postcode(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.upper(c)), r"\s+", " ")


def is_outcode(c: Column) -> Column:
    return F.trim(c).rlike(f"(?i)^{OUTCODE}$")


def extract_outcode(c: Column) -> Column:
    """The prefix of the upper-cased text; an unspaced full postcode gives one character more."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(c)), f"^({OUTCODE})", 1), F.lit(""))


def first_token(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")[0]


def is_full_postcode(c: Column) -> Column:
    return normalize_postcode(c).rlike(FULL_POSTCODE)


def extract_postcode(c: Column) -> Column:
    """The first postcode in the text, its halves joined by one space; an outcode on its own too."""
    out = F.regexp_extract(F.upper(c), POSTCODE_IN_TEXT, 1)
    inner = F.regexp_extract(F.upper(c), POSTCODE_IN_TEXT, 2)
    return F.nullif(F.trim(F.concat(out, F.lit(" "), inner)), F.lit(""))


def normalize_street_name(c: Column) -> Column:
    street = "(^|\\s)(" + "|".join(STREET_WORDS) + ")(\\s|$)"
    c = F.regexp_replace(F.lower(c), r"^(flat|unit|apt|apartment)\s*\d+[a-z]?\s*,?\s*", "")
    named = F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x.rlike(street))
    c = F.coalesce(F.when(c.contains(","), F.get(named, F.lit(0))), c)
    c = F.regexp_replace(c, r"^the\s+", "")
    for short, word in ABBREVIATIONS.items():
        c = F.regexp_replace(c, rf"\b{short}\b", word)
    c = F.regexp_replace(c, r"[a-z]{1,2}\d{1,2}[a-z]?\s*\d?[a-z]{0,2}", "")
    c = F.regexp_replace(c, rf"\b({'|'.join(PLACES)})\b", "")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, ",", " "), r"\s+", " "))
    c = F.regexp_extract(c, r"^(.*?)(\s+(near|off|behind|opposite)\s+.*)?$", 1)
    return F.regexp_replace(c, r"^\d+[a-z]?\s+", "")


# The patterns here and in normalize_street_name decide what is found.
def address_numbers(c: Column) -> Column:
    """Flat numbers and a leading house number, as a set."""
    low = F.lower(c)
    flats = F.regexp_extract_all(low, F.lit(r"(?:flat|unit|apt|apartment)\s*(\d+[a-z]?)"), F.lit(1))
    house = F.regexp_extract(low, r"^(\d+[a-z]?)\s+\w", 1)
    return F.array_sort(F.array_distinct(F.filter(F.concat(flats, F.array(house)), lambda x: x != "")))
