"""Joins of listings with analyses, anchors, reference data and coordinates."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgraph.functions import address as A
from hearthgraph.functions import geo as G
from hearthgraph.sources.snapshots import stored


def listing_with_analysis(listings: DataFrame, analyses: DataFrame) -> DataFrame:
    return listings.join(analyses, "unique_id", "left")


def link_by_url(listings: DataFrame, golden: DataFrame) -> DataFrame:
    """merged_id of listings without one, where their URL is in a golden record's source_urls."""
    urls = golden.select(F.col("golden_id"), F.explode(F.map_values("source_urls")).alias("url")).groupBy("url").agg(F.min("golden_id").alias("_g"))
    return listings.join(urls, "url", "left").withColumn("merged_id", F.coalesce("merged_id", "_g")).drop("_g")


def apply_links(listings: DataFrame, links: DataFrame) -> DataFrame:
    """links (unique_id, merged_id), one for each id."""
    new = links.select("unique_id", F.col("merged_id").alias("_m"))
    return listings.join(new, "unique_id", "left").withColumn("merged_id", F.coalesce("_m", "merged_id")).drop("_m")


def micro_area_lookup(df: DataFrame, ward_map: DataFrame, micro: DataFrame) -> DataFrame:
    """name by (outcode, ward), if the outcode's list (micro) has it; else by the address's words."""
    legal = ward_map.join(micro.select("outcode", "name").distinct(), ["outcode", "name"], "left_semi").select("outcode", "ward", F.col("name").alias("by_ward"))
    df = df.join(legal, ["outcode", "ward"], "left")
    found = micro_area_text_match(df.select("unique_id", "outcode", "address"), micro)
    return df.join(found, "unique_id", "left").withColumn("micro_area", F.coalesce("by_ward", "by_text")).drop("by_ward", "by_text")


def micro_area_text_match(df: DataFrame, micro: DataFrame) -> DataFrame:
    """unique_id, by_text: of the outcode's areas (pos, name, phrases, words, streets) the best for
    the address: 10 for a phrase, else 3 for each word, 5 for each street; above zero, first wins.

    An outcode has a handful of areas, so the join makes that many rows for each listing."""
    hits = lambda c: F.size(F.filter(c, lambda p: F.contains(F.lower("address"), p)))
    score = F.when(hits("phrases") > 0, 10).otherwise(3 * hits("words")) + 5 * hits("streets")
    both = df.join(micro, "outcode").withColumn("_s", score).where("_s > 0")
    return both.groupBy("unique_id").agg(F.max_by("name", F.struct("_s", -F.col("pos"))).alias("by_text"))


#: The reference tables of an area, and what each is keyed by.
AREA_KEYS = {"boroughs": ["outcode"], "trends": ["borough"], "tax": ["borough"], "noise": ["borough"], "benchmarks": ["outcode", "bedrooms"], "crime": ["outcode"], "hosting": ["outcode"], "scene": ["outcode"], "acoustics": ["property_type"]}


def area_context(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """df (outcode, bedrooms, property_type) with the columns of each reference table in dims, by
    AREA_KEYS: borough by outcode; rent trend, council tax and noise enforcement by borough; rent
    benchmarks, crime, hosting tolerance and creative scene by outcode; acoustics by property type.
    A key that a table has not gives nulls. The tables are small; Spark broadcasts them by size."""
    unknown = set(dims) - set(AREA_KEYS)
    if unknown:
        raise ValueError(f"no reference tables {sorted(unknown)}")
    for name, keys in AREA_KEYS.items():  # boroughs come first: other tables are keyed by them
        if name in dims:
            df = df.join(dims[name], keys, "left")
    return df


NEAR_RINGS = 4  # grids that every row is looked up in; with 500 m the largest has cubes of 4 km


def nearest_reference(df: DataFrame, ref: DataFrame, metres: float) -> DataFrame:
    """df (unique_id, postcode, latitude, longitude) with label: of the nearest reference point
    (latitude, longitude, label), else of the same full postcode.

    Places are taken as points of a sphere in space, so poles and the date line are like any
    other place. Grids of cubes `metres` wide, twice that, and so on are laid out, up to one whose
    neighbours hold the whole earth; so every row with a place finds a point. A row's finest grid
    with a point in its own or a neighbouring cube tells that the nearest is at most 2 * sqrt(3)
    cubes off; the grid two steps coarser holds every point that near in its 27 cubes. Equal places
    are one entry on both sides: of the points of one place only the first label can be found."""
    rings = max(0, math.ceil(math.log2(2 * G.EARTH_M / metres))) + 1
    axes, off = ["x", "y", "z"], F.array(F.lit(-1), F.lit(0), F.lit(1))

    def cubes(d: DataFrame, lat: str, lon: str) -> DataFrame:
        """d (with ring) with the cube of each row's place."""
        la, lo = F.radians(lat), F.radians(lon)
        place = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
        return d.withColumns({n: F.floor(c * G.EARTH_M / (metres * F.pow(F.lit(2.0), F.col("ring")))) for n, c in place.items()})

    def at_rings(d: DataFrame, lo: int, hi: int) -> DataFrame:
        return d.withColumn("ring", F.explode(F.array(*map(F.lit, range(lo, hi)))))

    def around(d: DataFrame) -> DataFrame:
        for c in axes:
            d = d.withColumn(f"_{c}", F.explode(off))
        return d.withColumns({c: F.col(c) + F.col(f"_{c}") for c in axes}).drop(*(f"_{c}" for c in axes))

    here = ["latitude", "longitude"]
    places = ref.dropna(subset=here).groupBy(F.col("latitude").alias("_la"), F.col("longitude").alias("_lo")).agg(F.min("label").alias("by_place"))
    points = cubes(at_rings(places, 0, rings + 2), "_la", "_lo")

    # cubes of several rings and neighbours are more rows than Spark's sizes count: never broadcast
    def finest(d: DataFrame, lo: int, hi: int) -> DataFrame:
        taken = around(points.where(F.col("ring").between(lo, hi - 1)).select("ring", *axes).distinct()).distinct()
        return cubes(at_rings(d, lo, hi), *here).join(taken.hint("merge"), ["ring", *axes], "left_semi").groupBy(*here).agg((F.min("ring") + 2).alias("ring"))

    # large cubes hold many rows, so only those that have found nothing near come to them
    own, cut = df.select(*here).dropna().distinct(), min(NEAR_RINGS, rings)
    at = finest(own, 0, cut)
    if cut < rings:
        at = at.union(finest(own.join(at.hint("merge"), here, "left_anti"), cut, rings))
    d = G.haversine_m(F.col("latitude"), F.col("longitude"), F.col("_la"), F.col("_lo"))
    near = around(cubes(at, *here)).join(points.hint("merge"), ["ring", *axes]).withColumn("_d", d)
    found = near.groupBy(*here).agg(F.min_by("by_place", F.struct("_d", "by_place")).alias("by_place"))
    codes = ref.where("postcode is not null").groupBy(A.normalize_postcode(F.col("postcode")).alias("_pc")).agg(F.min("label").alias("by_code"))
    out = df.withColumn("_pc", F.when(A.is_full_postcode(F.col("postcode")), A.normalize_postcode(F.col("postcode")))).join(codes, "_pc", "left").join(found, here, "left")
    return out.withColumn("label", F.coalesce("by_place", "by_code")).drop("_pc", "by_place", "by_code")


def geocode(df: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates of full postcodes for rows without; outcodes alone get none."""
    c = coords.select(A.normalize_postcode(F.col("postcode")).alias("_pc"), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo")).dropDuplicates(["_pc"])
    out = df.withColumn("_pc", F.when(~A.is_outcode(F.col("postcode")), A.normalize_postcode(F.col("postcode")))).join(c, "_pc", "left")
    return out.withColumns({"latitude": F.coalesce("latitude", "_la"), "longitude": F.coalesce("longitude", "_lo")}).drop("_pc", "_la", "_lo")


def cached_backfill(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Coordinates, and a full postcode in place of an outcode or none, from the stored row."""
    s = stored.select("unique_id", F.col("postcode").alias("_pc"), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"))
    out = df.join(s, "unique_id", "left")
    better = F.col("_pc").isNotNull() & ~A.is_outcode(F.col("_pc")) & (F.col("postcode").isNull() | A.is_outcode(F.col("postcode")))
    return out.withColumns({"postcode": F.when(better, F.col("_pc")).otherwise(F.col("postcode")), "latitude": F.coalesce("latitude", "_la"), "longitude": F.coalesce("longitude", "_lo")}).drop("_pc", "_la", "_lo")


def golden_with_listings(golden: DataFrame, listings: DataFrame, source: str | None = None) -> DataFrame:
    """golden (golden_id, source, source_urls) with its listings as an array, by source; with a
    source, only those that have it in a listing, as their own, or in source_urls."""
    own = listings.groupBy(F.col("merged_id").alias("golden_id")).agg(F.array_sort(F.collect_list(F.struct("source", "unique_id", "price_pcm"))).alias("listings"))
    out = golden.join(own, "golden_id", "left")
    if source is None:
        return out
    has = F.coalesce(F.exists("listings", lambda x: x["source"] == source), F.lit(False)) | (F.col("source") == source) | F.map_contains_key("source_urls", F.lit(source))
    return out.where(has)


def enrich_from_details(golden: DataFrame, details: DataFrame) -> DataFrame:
    """golden (golden_id, sources, source_urls, postcode, latitude, longitude) joined to each
    source's details (url, gallery, floorplan, floor_area, postcode, latitude, longitude): galleries
    one after the other by source, the first floor plan, floor area and coordinates, and a full
    postcode where there is none or an outcode."""
    x = golden.select("golden_id", F.posexplode("sources").alias("pos", "s"), "source_urls").withColumn("url", F.element_at("source_urls", F.col("s")))
    d = x.join(details, "url").groupBy("golden_id").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("pos", "gallery")))["gallery"]).alias("gallery"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in ("floorplan", "floor_area", "postcode", "latitude", "longitude")),
    )
    out = golden.join(d, "golden_id", "left")
    weak = F.col("postcode").isNull() | A.is_outcode(F.col("postcode"))
    keep = {"postcode": F.when(weak, F.coalesce("_postcode", "postcode")).otherwise(F.col("postcode")), "latitude": F.coalesce("latitude", "_latitude"), "longitude": F.coalesce("longitude", "_longitude")}
    return out.withColumns(keep).withColumnsRenamed({"_floorplan": "floorplan", "_floor_area": "floor_area"}).drop("_postcode", "_latitude", "_longitude")


def image_hash_set(df: DataFrame, images: DataFrame, block: list[str]) -> DataFrame:
    """hashes: of the gallery, else of the main photo; only for rows whose block has several."""
    gallery = images.where("image_type = 'gallery' and phash is not null").groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "phash")))["phash"].alias("_g"))
    many = df.groupBy(*block).agg(F.count("*").alias("_n")).where("_n > 1").select(*block)
    kept = df.join(many, block, "left_semi")
    return kept.join(gallery, "unique_id", "left").withColumn("hashes", F.coalesce("_g", F.array("phash"))).drop("_g")


def labels_join(labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sure labels with their pairs, and the labels that no pair has."""
    sure = labels.where("label <> 'uncertain'")
    return sure.join(pairs, "pair_id"), sure.join(pairs.select("pair_id"), "pair_id", "left_anti")


_TOKEN = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words of two characters or more, in lower case."""
    return [w for w in _TOKEN.findall(text.lower()) if len(w) > 1]


def _texts(batches: Iterable[pa.RecordBatch], column: int = 0, size: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts (null: empty), few enough to be held as words."""
    for b in batches:
        for k in range(0, b.num_rows, size):
            part = b.slice(k, size)
            yield part, [x or "" for x in part.column(column).to_pylist()]


#: Different terms that a task holds before it passes their counts on.
HELD = 1 << 19


def _count_terms(docs: DataFrame, terms_of: Callable[[list[str]], list[str]]) -> DataFrame:
    """t, all (occurrences) and df (texts with it) of the terms that terms_of makes of a text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = Counter(), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["t", "all", "df"])
        for _, texts in _texts(batches):
            for text in texts:
                found = terms_of(words_of(text))
                n.update(found)
                df.update(set(found))
            if len(n) > HELD:
                yield out()
                n, df = Counter(), Counter()
        yield out()

    return docs.select("text").mapInArrow(run, "t string, all long, df long").groupBy("t").agg(F.sum("all").alias("all"), F.sum("df").alias("df"))


def _count_pairs(docs: DataFrame, words: list[str]) -> DataFrame:
    """pair (place of the first word times their number, plus that of the second), all and df of
    the neighbours that are both among words."""
    size = len(words)
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def merged(held: list[np.ndarray]) -> list[np.ndarray]:
        pair, n, df = (np.concatenate(x) for x in zip(*held))
        which, at = np.unique(pair, return_inverse=True)
        return [which, *(np.bincount(at, x, len(which)).astype("int64") for x in (n, df))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, held, many = shared.value.get, [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged(held)], ["pair", "all", "df"])
        for _, texts in _texts(batches):
            made = [[get(w, -1) for w in words_of(t)] for t in texts]
            at = np.fromiter(chain.from_iterable(made), "int64")
            doc = np.repeat(np.arange(len(made)), list(map(len, made)))
            near = (at[:-1] >= 0) & (at[1:] >= 0) & (doc[:-1] == doc[1:])
            key, n = np.unique((doc[:-1] * size * size + at[:-1] * size + at[1:])[near], return_counts=True)
            held.append([key % (size * size) if size else key, n, np.ones(len(key), "int64")])
            many += len(key)
            if many > 2 * HELD:
                held = [merged(held)]
                many = len(held[0][0])
                if many > HELD:
                    yield out()
                    held, many = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "pair long, all long, df long").groupBy("pair").agg(F.sum("all").alias("all"), F.sum("df").alias("df"))


def top_terms(docs: DataFrame, terms: int) -> list[tuple[str, int]]:
    """The `terms` most frequent words and word pairs of docs, most frequent first, then by name, with
    the number of texts that have each.

    A pair is no more frequent than either word of it. So with least as the frequency of word number
    `terms`, pairs above it are made of words above it, fewer than `terms`, and only those are
    counted. Should too few terms be above it, pairs as frequent as that word may count, and all are."""
    order = [F.desc("all"), "t"]
    single = stored(_count_terms(docs, lambda w: w), "words")
    first = single.orderBy(*order).limit(terms).collect()  # `terms` rows
    least = first[-1]["all"] if len(first) == terms else 0
    words = [r.t for r in first if r["all"] > least]
    named = docs.sparkSession.createDataFrame(list(enumerate(words)), "at long, t string")
    one, two = (named.select(F.col("at").alias(f"at{k}"), F.col("t").alias(f"t{k}")) for k in (1, 2))
    pairs = _count_pairs(docs, words).where(F.col("all") > least).withColumns({"at1": F.expr(f"pair div {max(len(words), 1)}"), "at2": F.col("pair") % max(len(words), 1)})
    pairs = pairs.join(F.broadcast(one), "at1").join(F.broadcast(two), "at2").select(F.concat_ws(" ", "t1", "t2").alias("t"), "all", "df")
    found = single.where(F.col("all") > least).unionByName(pairs).orderBy(*order).limit(terms).collect()
    if least and len(found) < terms:
        every = _count_terms(docs, lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])])
        found = single.unionByName(every).orderBy(*order).limit(terms).collect()
    return [(r.t, r.df) for r in found]


class Vocabulary:
    """Terms (words, and pairs of them) and how often each is in a text."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.at = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        self.size = len(self.at)
        self.alone = np.full(self.size + 1, -1)  # a last place for words that no term has
        pairs = []
        for number, t in enumerate(split):
            if len(t) == 1:
                self.alone[self.at[t[0]]] = number
            else:
                pairs.append((self.at[t[0]] * self.size + self.at[t[1]], number))
        self.pairs, self.numbers = np.array(sorted(pairs), "int64").reshape(-1, 2).T

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the text, number of the term and how often it is there, ascending by both."""
        made = [[self.at.get(w, -1) for w in words_of(t)] for t in texts]
        at = np.fromiter(chain.from_iterable(made), "int64")
        doc = np.repeat(np.arange(len(made)), list(map(len, made)))
        one = self.alone[at]
        found = [np.stack([doc, one])[:, one >= 0]]
        if len(self.pairs):
            key = at[:-1] * self.size + at[1:]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            near = (at[:-1] >= 0) & (at[1:] >= 0) & (doc[:-1] == doc[1:]) & (self.pairs[place] == key)
            found.append(np.stack([doc[:-1], self.numbers[place]])[:, near])
        doc, term = np.concatenate(found, axis=1)
        whole = len(self.alone) + len(self.pairs)
        key, n = np.unique(doc * whole + term, return_counts=True)
        return key // whole, key % whole, n


def tfidf_cosine(docs: DataFrame, pairs: DataFrame, terms: int = 5000, shortest: int = 20) -> DataFrame:
    """docs (id, text) and pairs (id_a, id_b) -> similarity over words and word pairs.

    Texts of fewer than `shortest` characters, and missing ones, give 0. If one text begins with
    the other, it is 1. Else both are cut to the length of the shorter, since portals cut texts.
    Weights: counts times ln((1+n)/(1+df)) + 1 over the whole texts of docs, of the `terms` most
    frequent terms; each side of length one.

    Lengths meet first, so it is known where each text of a pair is cut. Then each text goes once to
    its cuts, and what is left of it becomes counts of its terms and a digest; these meet in the
    pairs, texts never do."""
    n = docs.count()
    found = top_terms(docs, terms)
    weight = np.array([math.log((1.0 + n) / (1.0 + df)) + 1 for _, df in found])
    shared = docs.sparkSession.sparkContext.broadcast([t for t, _ in found])

    keyed = docs.select("id", F.xxhash64("text").alias("_h"), F.char_length("text").alias("_size"), "text")
    sizes = keyed.select("id", "_h", "_size").distinct()
    side = lambda s: sizes.select(*(F.col(c).alias(f"{c}_{s}") for c in sizes.columns))
    rows = pairs.join(side("a"), "id_a", "left").join(side("b"), "id_b", "left")
    cut = F.least(*(F.coalesce(f"_size_{s}", F.lit(0)) for s in "ab"))
    rows = stored(rows.select(*pairs.columns, "_h_a", "_h_b", cut.alias("_n"), F.monotonically_increasing_id().alias("_pair")), "text-pairs")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for part, texts in _texts(batches, 3):
            texts = [t[:k] for t, k in zip(texts, part.column(2).to_pylist())]
            doc, term, many = vocabulary.counts(texts)
            starts = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (term, many)]
            digest = pa.array([hashlib.blake2b(t.lower().encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digest, *lists], ["_pair", "_side", "text", "term", "n"])

    @F.arrow_udf("double")
    def cosine(term_a: pa.Array, n_a: pa.Array, term_b: pa.Array, n_b: pa.Array) -> pa.Array:
        def flat(term: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row = np.repeat(np.arange(len(term)), term.value_lengths().to_numpy(zero_copy_only=False))
            t = term.flatten().to_numpy(zero_copy_only=False)
            v = n.flatten().to_numpy(zero_copy_only=False) * weight[t]
            return row * (len(weight) + 1) + t, v, np.bincount(row, v * v, len(term))

        (i, v, norm_a), (j, w, norm_b) = flat(term_a, n_a), flat(term_b, n_b)
        key, p, q = np.intersect1d(i, j, assume_unique=True, return_indices=True)
        dot = np.bincount(key // (len(weight) + 1), v[p] * w[q], len(term_a))
        size = np.sqrt(norm_a * norm_b)
        return pa.array(np.divide(dot, size, out=np.zeros(len(term_a)), where=size > 0))

    # files are several times smaller than the rows in them, and texts than Spark takes them for: never broadcast
    own = F.explode(F.array(*(F.struct(F.lit(k).alias("_side"), F.col(f"id_{s}").alias("id"), F.col(f"_h_{s}").alias("_h")) for k, s in enumerate("ab"))))
    cuts = rows.where(F.col("_n") >= shortest).select("_pair", "_n", own.alias("_x")).select("_pair", "_n", "_x.*")
    made = keyed.hint("merge").join(cuts, ["id", "_h"]).select("_pair", "_side", "_n", "text")
    made = stored(made.mapInArrow(vectors, "_pair long, _side int, text binary, term array<int>, n array<int>"), "text-vectors")
    a, b = (made.where(F.col("_side") == k).select("_pair", *(F.col(c).alias(f"_{c}_{s}") for c in ("text", "term", "n"))) for k, s in enumerate("ab"))
    both = rows.join(a.hint("merge"), "_pair").join(b.hint("merge"), "_pair")
    similarity = F.when(F.col("_text_a") == F.col("_text_b"), 1.0).otherwise(cosine("_term_a", "_n_a", "_term_b", "_n_b"))
    short = rows.where(F.col("_n") < shortest).select(*pairs.columns, F.lit(0.0).alias("similarity"))
    return both.select(*pairs.columns, similarity.alias("similarity")).unionByName(short)
