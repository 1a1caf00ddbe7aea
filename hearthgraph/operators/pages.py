"""Listing pages as a table: embedded state, details, availability. Nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgraph.functions import address as A
from hearthgraph.functions import text as X

# Where each source's pages keep their state, and the paths of its fields.
STATE = {
    "rightmove": r"(?s)PAGE_MODEL\s*=\s*(\{.*?\})\s*</script>",
    "zoopla": r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>',
    "onthemarket": r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>',
}
PATHS = {
    "rightmove": {"id": "$.propertyData.id", "description": "$.propertyData.text.description", "price": "$.propertyData.prices.primaryPrice", "beds": "$.propertyData.bedrooms", "postcode": "$.propertyData.address.displayAddress", "latitude": "$.propertyData.location.latitude", "longitude": "$.propertyData.location.longitude", "images": "$.propertyData.images[*].url", "floorplan": "$.propertyData.floorplans[0].url"},
    "zoopla": {"id": "$.props.pageProps.listing.listingId", "description": "$.props.pageProps.listing.detailedDescription", "price": "$.props.pageProps.listing.pricing.label", "beds": "$.props.pageProps.listing.counts.numBedrooms", "postcode": "$.props.pageProps.listing.address", "latitude": "$.props.pageProps.listing.location.coordinates.latitude", "longitude": "$.props.pageProps.listing.location.coordinates.longitude", "images": "$.props.pageProps.listing.propertyMedia[*].original", "floorplan": "$.props.pageProps.listing.floorPlan"},
    "onthemarket": {"id": "$.props.initialReduxState.property.id", "description": "$.props.initialReduxState.property.description", "price": "$.props.initialReduxState.property.price", "beds": "$.props.initialReduxState.property.bedrooms", "postcode": "$.props.initialReduxState.property.displayAddress", "latitude": "$.props.initialReduxState.property.location.lat", "longitude": "$.props.initialReduxState.property.location.lon", "images": "$.props.initialReduxState.property.images[*].largeUrl", "floorplan": "$.props.initialReduxState.property.floorplan"},
}
ARRAYS = {"id": "PROPERTYIDS", "price": "prices", "beds": "bedrooms", "latitude": "PROPERTYLISTLATITUDES", "longitude": "PROPERTYLISTLONGITUDES"}
PUSH = r'(?s)self\.__next_f\.push\(\s*\[\s*1\s*,\s*"((?:[^"\\]|\\.)*+)"\s*\]\s*\)'
FEATURES = {
    "rightmove": ["$.propertyData.keyFeatures"],
    "zoopla": ["$.props.pageProps.listing.features.bullets"],
    "onthemarket": ["$.props.initialReduxState.property.keyFeatures", "$.props.initialReduxState.property.bullets", "$.props.initialReduxState.property.features[*].feature"],
}
OPENRENT = {
    "description": r'(?is)<div[^>]*class="[^"]*description[^"]*"[^>]*>(.*?)</div>',
    "features": r'(?is)<ul[^>]*class="[^"]*feature[^"]*"[^>]*>(.*?)</ul>',
    "photos": [r'(?i)<a[^>]*href="([^"]+)"[^>]*class="[^"]*lightbox_item[^"]*"', r'(?i)<a[^>]*href="([^"]+)"[^>]*data-lightbox="gallery"', r"(?i)(//imagescdn\.openrent\.co\.uk/listings/\d+/[^\"]+\.(?:jpg|jpeg|png|webp))"],
    "floorplan": r'(?i)href="(//imagescdn\.openrent\.co\.uk/[^"]*floorplan[^"]*)"',
}
CARD = {
    "mark": r'data-testid="propertyCard-\d+"|data-test="propertyCard"',
    "link": r'(?i)<a[^>]*href="([^"]*/properties/\d+[^"]*)"',
    "address": r"(?is)<address[^>]*>(.*?)</address>",
    "title": r"(?is)<h2[^>]*>(.*?)</h2>",
    "beds": r'(?is)<span[^>]*class="[^"]*bedroomsCount[^"]*"[^>]*>\s*(\d+)',
    "details": r'(?is)data-testid="property-details-lozenge"[^>]*>(.*?)</',
    "price": r'(?is)(?:data-testid="property-price"|class="propertyCard-priceValue")[^>]*>(.*?£[^<]*)<',
    "image": r'(?i)<img[^>]*src="([^"]+)"',
}
SITES = {"openrent": "https://www.openrent.co.uk", "rightmove": "https://www.rightmove.co.uk", "zoopla": "https://www.zoopla.co.uk", "onthemarket": "https://www.onthemarket.com"}
MARKERS = {"openrent": "PROPERTYIDS", "rightmove": "propertyCard", "zoopla": "regularListingsFormatted", "onthemarket": "initialReduxState"}
CHALLENGE = "checking your browser|cloudflare|just a moment|ray id|enable javascript and cookies"
REMOVED = {
    "rightmove": "(?i)property has been removed|no longer available|no longer on the market",
    "zoopla": "(?i)no longer available|this property has been removed",
    "openrent": "(?i)no longer available|property not found",
    "onthemarket": "(?i)no longer available|property has been removed",
}
LET_AGREED = {
    "rightmove": r'(?i)"tags"\s*:\s*\[.*?"LET_AGREED"|(?<![?&=a-zA-Z])let[\s_]agreed(?![a-zA-Z=&])',
    "zoopla": r"(?i)(?<![?&=a-zA-Z])let(?:ting)?\s+agreed(?![a-zA-Z=&])",
    "onthemarket": r"(?i)(?<![?&=a-zA-Z/-])let[\s-]agreed(?![a-zA-Z=&])|(?<![?&=a-zA-Z])under\s+offer(?![a-zA-Z=&])",
}


def by_source(table: dict[str, Column], default: Column | None = None) -> Column:
    out = F.when(F.lit(False), default)
    for source, value in table.items():
        out = out.when(F.col("source") == source, value)
    return out.otherwise(default) if default is not None else out


def pushed(html: Column) -> Column:
    """The JSON texts that a page pushes piece by piece: what follows the first colon of each."""
    raw = F.regexp_extract_all(html, F.lit(PUSH), F.lit(1))
    texts = F.transform(raw, lambda x: F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")[0])
    return F.transform(F.filter(texts, lambda t: F.contains(t, F.lit(":"))), lambda t: F.substring(t, F.locate(":", t) + 1, F.lit(1 << 30)))


def after_key(text: Column, key: str) -> Column:
    """The text that begins with the value of a key; from_json reads that value and no more."""
    name = f'"{key}":'
    return F.when(F.contains(text, F.lit(name)), F.substring(text, F.locate(name, text) + len(name), F.lit(1 << 30)))


def embedded_json(pages: DataFrame) -> DataFrame:
    """pages (source, html, ...) with state: the page's JSON text, or the pieces that it pushes one
    after the other; null if there is neither."""
    whole = F.nullif(by_source({s: F.regexp_extract("html", p, 1) for s, p in STATE.items()}), F.lit(""))
    pieces = F.nullif(F.array_join(pushed(F.col("html")), "\n"), F.lit(""))
    return pages.withColumn("state", F.coalesce(whole, F.when(F.col("html").contains("__next_f.push"), pieces)))


def details_from_pages(pages: DataFrame, gallery: int = 10) -> DataFrame:
    """pages with the fields of a detail page, features (an array) and floor_area_sqm among them;
    photos without energy charts, videos, other files and the floor plan, `gallery` of them at
    most. Fields that a page has not are null."""
    rows = embedded_json(pages)
    take = lambda name: by_source({s: F.get_json_object("state", p[name]) for s, p in PATHS.items()})
    rows = rows.withColumns({name: take(name) for name in ("id", "description", "price", "beds", "postcode", "latitude", "longitude", "floorplan", "images")})
    open_ = F.col("source") == "openrent"
    whole = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    # the first pattern that finds any
    shown = [F.filter(F.regexp_extract_all("html", F.lit(p), F.lit(1)), lambda u: ~F.lower(u).contains("floorplan")) for p in OPENRENT["photos"]]
    found = F.transform(F.coalesce(*[F.when(F.size(x) > 0, x) for x in shown]), whole)
    urls = F.coalesce(F.from_json("images", "array<string>"), F.when(F.col("images").isNotNull(), F.array("images")), F.when(open_, found), F.array().cast("array<string>"))
    some = lambda name: F.nullif(F.regexp_extract("html", OPENRENT[name], 1), F.lit(""))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))
    items = F.transform(F.regexp_extract_all(some("features"), F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), plain)

    def texts(path: str) -> Column:
        found = F.get_json_object("state", path)  # several, or one without brackets
        return F.coalesce(F.from_json(found, "array<string>"), F.when(found.isNotNull(), F.array(F.regexp_replace(found, '^"|"$', ""))))

    lists = {s: F.filter(F.concat(*[F.coalesce(texts(p), F.array().cast("array<string>")) for p in paths]), lambda x: x != "") for s, paths in FEATURES.items()}
    features = by_source(lists | {"openrent": F.filter(items, lambda x: x != "")})
    sizings = F.from_json(F.get_json_object("state", "$.propertyData.sizings"), "array<struct<unit:string,minimumSize:double,maximumSize:double>>")
    sizes = F.transform(F.filter(sizings, lambda z: z["unit"] == "sqft"), lambda z: X.sqft_to_sqm(F.coalesce(F.nullif(z["maximumSize"], F.lit(0.0)), z["minimumSize"])))
    area = by_source({
        "rightmove": F.get(F.filter(sizes, lambda x: x.isNotNull()), F.lit(0)),
        "zoopla": X.sqft_to_sqm(F.regexp_extract("state", r'"sizeSqft"\s*:\s*(\d+)', 1).try_cast("double")),
        "onthemarket": X.sqft_to_sqm(F.get_json_object("state", "$.props.initialReduxState.property.minimumAreaSqFt").try_cast("double")),
    })
    rows = rows.withColumns({"description": F.when(open_, F.nullif(plain(some("description")), F.lit(""))).otherwise(F.col("description")), "floorplan": F.when(open_, whole(some("floorplan"))).otherwise(F.col("floorplan"))})
    ok = lambda u: ~X.is_epc_url(u) & ~X.is_video_url(u) & X.is_image_url(u) & ~F.coalesce(u == F.col("floorplan"), F.lit(False))
    return rows.withColumns({
        "gallery": F.slice(F.filter(urls, ok), 1, gallery),
        "features": F.when(F.size(features) > 0, features),
        "floor_area_sqm": area,
        "price": X.extract_price(F.col("price")),
        "beds": F.col("beds").cast("int"),
        "postcode": A.extract_postcode(F.col("postcode")),
        "latitude": F.col("latitude").cast("double"),
        "longitude": F.col("longitude").cast("double"),
    }).drop("state", "images")


def listings_from_arrays(pages: DataFrame) -> DataFrame:
    """Search pages that keep parallel arrays in a script -> a row for each place; rows without id,
    price or beds go."""
    one = lambda name: F.from_json(F.nullif(F.regexp_extract("html", rf"(?s)\b{name}\s*=\s*(\[[^\]]*\])", 1), F.lit("")), "array<double>")
    z = F.arrays_zip(*[one(v).alias(k) for k, v in ARRAYS.items()])
    rows = pages.select("url", F.posexplode(z).alias("pos", "x")).select("url", "pos", "x.*")
    return rows.dropna(subset=["id", "price", "beds"]).withColumns({"id": F.col("id").cast("long").cast("string"), "price": F.col("price").cast("int"), "beds": F.col("beds").cast("int")})


_SEARCH = "array<struct<listingId:bigint,listingUris:struct<detail:string>,detailUrl:string,priceUnformatted:double,price:string,features:string,title:string,address:string,image:struct<src:string>,pos:struct<lat:double,lng:double>>>"
_RESULTS = "array<struct<id:string,`details-url`:string,`short-price`:string,bedrooms:int,`property-title`:string,address:string,images:array<struct<default:string,webp:string>>,`cover-image`:struct<default:string,webp:string>,location:struct<lat:double,lon:double>>>"
_ROW = ["page", "pos", "source", "id", "url", "title", "price", "beds", "address", "image_url", "latitude", "longitude"]


def _zoopla_cards(pages: DataFrame) -> DataFrame:
    """Pushed pieces that hold the list, else the page's state."""
    pieces = F.filter(pushed(F.col("html")), lambda t: F.contains(t, F.lit("regularListingsFormatted")))
    state = F.nullif(F.regexp_extract("html", STATE["zoopla"], 1), F.lit(""))
    lists = F.flatten(F.transform(F.concat(pieces, F.filter(F.array(state), lambda x: x.isNotNull())), lambda t: F.from_json(after_key(t, "regularListingsFormatted"), _SEARCH)))
    c = lambda x: F.col(f"c.{x}")
    rows = pages.where("source = 'zoopla'").select(F.col("url").alias("page"), F.posexplode(lists).alias("pos", "c"))
    icons = F.from_json(c("features"), "array<struct<iconId:string,content:string>>")
    icon = F.get(F.filter(icons, lambda x: (x["iconId"] == "bed") & x["content"].rlike(r"^\d+$")), F.lit(0))["content"]
    beds = F.coalesce(F.when(c("features").startswith("["), icon.try_cast("int")), F.when(c("features").startswith("{"), F.get_json_object(c("features"), "$.beds").try_cast("int")), X.extract_bedrooms(c("title")))
    weekly = F.lower(F.coalesce(c("price"), F.lit(""))).contains("pw")
    price = F.floor(F.floor(c("priceUnformatted")) * F.when(weekly, 52 / 12).otherwise(1.0)).cast("int")
    image = F.when(c("image.src").startswith("http"), c("image.src")).otherwise(F.concat(F.lit("https:"), c("image.src")))
    text = lambda a, b: F.coalesce(F.nullif(c(a), F.lit("")), c(b))
    return rows.select("page", "pos", F.lit("zoopla").alias("source"), c("listingId").cast("string").alias("id"), F.coalesce(c("listingUris.detail"), c("detailUrl")).alias("url"), text("title", "address").alias("title"), F.coalesce(price, X.extract_price(c("price"))).alias("price"), beds.alias("beds"), text("address", "title").alias("address"), image.alias("image_url"), c("pos.lat").alias("latitude"), c("pos.lng").alias("longitude"))


def _onthemarket_cards(pages: DataFrame) -> DataFrame:
    state = F.regexp_extract("html", STATE["onthemarket"], 1)
    rows = pages.where("source = 'onthemarket'").select(F.col("url").alias("page"), F.posexplode(F.from_json(F.get_json_object(state, "$.props.initialReduxState.results.list"), _RESULTS)).alias("pos", "c"))
    c = lambda x: F.col(f"c.{x}")
    link = c("`details-url`")
    id_ = F.coalesce(F.nullif(c("id"), F.lit("")), F.nullif(F.regexp_extract(link, r"/details/(\d+)", 1), F.lit("")))
    first = F.get(c("images"), F.lit(0))
    image = F.coalesce(first["default"], first["webp"], c("`cover-image`.default"), c("`cover-image`.webp"))
    return rows.select("page", "pos", F.lit("onthemarket").alias("source"), id_.alias("id"), F.nullif(link, F.lit("")).alias("url"), F.coalesce(c("`property-title`"), c("address")).alias("title"), X.extract_price(c("`short-price`")).alias("price"), F.coalesce(c("bedrooms"), X.extract_bedrooms(c("`property-title`"))).alias("beds"), F.nullif(c("address"), F.lit("")).alias("address"), image.alias("image_url"), c("location.lat").alias("latitude"), c("location.lon").alias("longitude"))


def _rightmove_cards(pages: DataFrame) -> DataFrame:
    """A card is what stands between its mark and the next one's."""
    cards = F.slice(F.split("html", CARD["mark"]), 2, 1 << 20)
    rows = pages.where("source = 'rightmove'").select(F.col("url").alias("page"), F.posexplode(cards).alias("pos", "card"))
    some = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("card", CARD[name], 1), r"<[^>]+>|\s+", " ")), F.lit(""))
    link, title = some("link"), some("title")
    beds = F.coalesce(some("beds").try_cast("int"), X.extract_bedrooms(title), X.extract_bedrooms(some("details")))
    return rows.select("page", "pos", F.lit("rightmove").alias("source"), F.nullif(F.regexp_extract(link, r"/properties/(\d+)", 1), F.lit("")).alias("id"), F.split(link, "#")[0].alias("url"), F.coalesce(title, some("address")).alias("title"), X.extract_price(some("price")).alias("price"), beds.alias("beds"), some("address").alias("address"), some("image").alias("image_url"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))


def _openrent_cards(pages: DataFrame) -> DataFrame:
    rows = listings_from_arrays(pages.where("source = 'openrent'"))
    none = F.lit(None).cast("string")
    return rows.select(F.col("url").alias("page"), "pos", F.lit("openrent").alias("source"), "id", F.concat(F.lit("/"), "id").alias("url"), none.alias("title"), "price", "beds", none.alias("address"), none.alias("image_url"), "latitude", "longitude")


def listings_from_pages(pages: DataFrame) -> DataFrame:
    """Search pages (source, url, html) of the four portals -> a row for each listing, with its
    postcode. Rows without id, url, price or bedrooms and shared homes are left out; half a pair of
    coordinates is none; of a repeated id the first page's row stays."""
    rows = _zoopla_cards(pages).select(_ROW)
    for cards in (_onthemarket_cards, _rightmove_cards, _openrent_cards):
        rows = rows.union(cards(pages).select(_ROW))
    rows = rows.dropna(subset=["id", "url", "price", "beds"]).where(F.col("address").isNotNull() | (F.col("source") != "onthemarket"))
    rows = rows.where(X.exclude_shared(F.coalesce("title", F.lit(""))))
    base = by_source({s: F.lit(b) for s, b in SITES.items()})
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    rows = rows.withColumns({"url": F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(base, "url")), "latitude": F.when(both, F.col("latitude")), "longitude": F.when(both, F.col("longitude")), "postcode": A.extract_postcode(F.col("address"))})
    w = Window.partitionBy("source", "id").orderBy("page", "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page_status(pages: DataFrame) -> DataFrame:
    """pages (source, status_code, url, html, challenged) with status. The order of the tests
    differs: openrent looks for its redirect before the challenge page."""
    c = F.col
    challenge = c("challenged") | F.substring(F.lower("html"), 1, 3000).rlike(CHALLENGE)
    redirect = by_source({
        "rightmove": c("url").contains("/property-to-rent/find") & ~c("url").contains("/properties/"),
        "openrent": c("url").contains("/properties-to-rent") | F.substring(F.lower("html"), 1, 1000).contains("homepage"),
        "onthemarket": c("url").contains("/to-rent/") & ~c("url").contains("/details/"),
    }, F.lit(False))
    removed = by_source({s: F.substring("html", 1, 5000).rlike(p) for s, p in REMOVED.items()}, F.lit(False))
    agreed = by_source({s: c("html").rlike(p) for s, p in LET_AGREED.items()}, F.lit(False))
    status = (
        F.when(c("status_code").isin(404, 410), "removed")
        .when(c("status_code") != 200, "unknown")
        .when((c("source") == "openrent") & redirect, "removed")
        .when(challenge, "unknown")
        .when(redirect | removed, "removed")
        .when(agreed, "let_agreed")
        .otherwise("active")
    )
    return pages.withColumn("status", F.coalesce(status, F.lit("unknown")))


def parse_health(pages: DataFrame, parsed: DataFrame, markers: dict[str, str] | None = None) -> DataFrame:
    """Per source: pages with containers but no parsed row mean that the layout changed."""
    held = F.coalesce(by_source({s: F.col("html").contains(m) for s, m in (markers or MARKERS).items()}), F.lit(False))
    seen = pages.groupBy("source").agg(F.sum(held.cast("int")).alias("containers"))
    got = parsed.groupBy("source").agg(F.count("*").alias("parsed"))
    out = seen.join(got, "source", "left").fillna(0, subset=["parsed"])
    return out.withColumn("layout_changed", (F.col("containers") > 0) & (F.col("parsed") == 0))
