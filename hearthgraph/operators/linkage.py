"""Record linkage: candidate pairs, pair scores, similarity joins, grouping and fusion.

Listings have unique_id, source, price_pcm, bedrooms, address, postcode, latitude, longitude,
first_seen and, for images, hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthgraph.functions import address as A
from hearthgraph.functions import geo as G
from hearthgraph.operators.graph import components
from hearthgraph.sources.snapshots import stored

# Weights and limits of the pair score.
WEIGHTS = {"image_hash": 40.0, "full_postcode": 40.0, "coordinates": 40.0, "street": 20.0, "outcode": 10.0, "price": 15.0}
MATCH_AT, SIGNALS_AT, GROUP_AT_MOST, HASH_BITS = 60.0, 2, 4, 8


def keyed(df: DataFrame) -> DataFrame:
    """df with outcode, street and full_postcode, which blocks and signals use."""
    return df.withColumns({"outcode": A.extract_outcode(F.col("postcode")), "street": A.normalize_street_name(F.col("address")), "full_postcode": F.when(A.is_full_postcode(F.col("postcode")), A.normalize_postcode(F.col("postcode")))})


def with_sources(df: DataFrame) -> DataFrame:
    """df with sources: those of a golden record, else the one source of a listing."""
    return df if "sources" in df.columns else df.withColumn("sources", F.array("source"))


def strangers() -> Column:
    """The two sides of a pair have no source in common."""
    return ~F.arrays_overlap("sources_a", "sources_b")


def _sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns)) for s in "ab")


def candidate_pairs(df: DataFrame, block: list[str], salts: int = 1) -> DataFrame:
    """All pairs of a block whose sides share no source (sources of a golden record, else source),
    as columns with _a and _b; a null key pairs with none.

    salts deals each block to that many tasks: one side by hash, the other copied to each."""
    df = with_sources(df).dropna(subset=block)
    a, b = _sides(df)
    on = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in block]
    if salts > 1:
        a = a.withColumn("_sa", F.pmod(F.xxhash64("unique_id_a"), F.lit(salts)))
        b = b.withColumn("_sb", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append(F.col("_sa") == F.col("_sb"))
    pairs = a.join(b, [*on, F.col("unique_id_a") < F.col("unique_id_b"), strangers()])
    return pairs.drop("_sa", "_sb")


def pair_extents(df: DataFrame, block: list[str]) -> DataFrame:
    """For each block the number of its candidate_pairs, the first id on their left sides and the
    last on their right ones, without listing them: records of one block and the same sources are
    one entry, and entries without a common source meet. Each such two have n * m pairs, of which
    the smallest id of both is a left side and the largest a right one. unique_id is a key of df."""
    df = with_sources(df).dropna(subset=[*block, "unique_id"]).withColumn("sources", F.sort_array("sources"))
    a, b = _sides(df.groupBy(*block, "sources").agg(F.count("*").alias("n"), F.min("unique_id").alias("first"), F.max("unique_id").alias("last")))
    on = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in block]
    met = a.join(b, [*on, F.col("sources_a") <= F.col("sources_b"), strangers()])
    # records without any source are strangers to their like
    n = F.when(F.col("sources_a") == F.col("sources_b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    met = met.select(*(F.col(f"{c}_a").alias(c) for c in block), n.alias("n"), F.least("first_a", "first_b").alias("first"), F.greatest("last_a", "last_b").alias("last"))
    return met.where("n > 0").groupBy(*block).agg(F.sum("n").alias("pairs"), F.min("first").alias("first_a"), F.max("last").alias("last_b"))


def hash_halves(h: Column) -> list[Column]:
    """A 16-digit hex hash as two numbers, since it exceeds a long."""
    return [F.conv(F.substring(h, k, 8), 16, 10).cast("long") for k in (1, 9)]


def main_photo(h: Column) -> Column:
    """A 16-digit hex hash as one long, where a record meets many; null as its halves are."""
    high, low = hash_halves(h)
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(hash_halves(a), hash_halves(b))), F.lit(0))


def _blocks(most: int) -> list[tuple[int, int]]:
    """Blocks (first bit, bits) of a 64-bit hash, so many that two hashes that differ in at most
    `most` bits differ in at most two bits of one block."""
    n = most // 3 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


#: Bits of a block by which entries are dealt to tasks (usually), and hashes of a key in a task by them.
DEALT_BITS, HASHES_IN_TASK = 6, 20_000


def hamming_join(a: DataFrame, b: DataFrame, a_hash: str, b_hash: str, most: int = HASH_BITS, a_key: list[str] | None = None, b_key: list[str] | None = None, tasks: int | None = None, bits: int = DEALT_BITS) -> DataFrame:
    """Rows of a and b whose hashes (16 hex digits, or longs) differ in at most `most` bits, with distance.

    Each different hash (of a key) is one entry. Its blocks, and each block with one bit flipped,
    are equi-join keys: two bits of difference meet as one flip on either side. A pair is kept in
    the first block in which it is so near, and there where the left side's flip is the lowest
    differing bit (none below two), so it comes out once. With three blocks for eight bits the
    pairs compared are some 6 in 10,000 of all.

    Entries are dealt to tasks by key, block and its first `bits`, so only flips of those are shuffled
    (21 rows of a hash at three blocks and 6 bits); the flips of the other bits (67 entries in all) are
    made in the task. Both sides of a table joined with itself are shuffled once, where they are named alike.
    tasks: into how many to deal, else as many as Spark has shuffle partitions. What only meets
    because hashes of keys collide is sorted out. Null hashes and keys meet nothing."""
    a_key, b_key = a_key or [], b_key or []
    blocks = _blocks(most)
    masks = [_signed(((1 << n) - 1) << lo) for lo, n in blocks]
    long = lambda x: F.lit(x).cast("long")
    tasks = tasks or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # else entries made in a task would be shuffled again, by all columns that they meet by
    a.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    cuts = [lo + max(n - bits, n // 2) for lo, n in blocks]  # bits from here on deal
    dealt = [(k, _signed(m)) for k, (lo, n) in enumerate(blocks) for m in (0, *(1 << i for i in range(cuts[k], lo + n)))]
    fine = [[0, *(_signed(1 << i) for i in range(lo, cuts[k]))] for k, (lo, _) in enumerate(blocks)]

    def of_block(values: list[int], at: Column) -> Column:
        out = long(values[0])
        for k, x in list(enumerate(values))[1:]:
            out = F.when(at == k, long(x)).otherwise(out)
        return out

    def marked(df: DataFrame, h: str, key: list[str], side: str) -> DataFrame:
        return df.withColumns({f"_v{side}": F.col(h) if dict(df.dtypes)[h] == "bigint" else main_photo(F.col(h)), f"_g{side}": F.xxhash64(*key) if key else long(0)})

    def entries(df: DataFrame, key: list[str], side: str) -> DataFrame:
        v, g = F.col("_v"), F.col("_g")
        at, flip = F.get(F.array(*[F.lit(k) for k, _ in dealt]), F.col("_code")), F.get(F.array(*[long(m) for _, m in dealt]), F.col("_code"))
        rows = df.dropna(subset=[f"_v{side}", *key]).select(F.col(f"_v{side}").alias("_v"), F.col(f"_g{side}").alias("_g")).distinct()
        rows = rows.withColumn("_code", F.explode(F.sequence(F.lit(0), F.lit(len(dealt) - 1))))
        first = of_block([_signed(((1 << n) - 1) << lo & ~((1 << cut) - 1)) for (lo, n), cut in zip(blocks, cuts)], at)
        rows = rows.withColumn("_part", F.xxhash64(g, at, v.bitwiseXOR(flip).bitwiseAND(first))).repartition(tasks, "_part")
        flips = F.array(*[F.array(*map(long, x)) for x in fine])
        rows = rows.withColumn("_fine", F.explode(F.when(flip == 0, F.get(flips, at)).otherwise(F.array(flip))))
        block = v.bitwiseXOR(F.col("_fine")).bitwiseAND(of_block(masks, at))
        return rows.select(block.alias("_block"), "_part", v.alias(f"_v{side}"), g.alias(f"_g{side}"), F.col("_fine").alias(f"_flip{side}"), at.alias(f"_at{side}"))

    a, b = marked(a, a_hash, a_key, "a"), marked(b, b_hash, b_key, "b")
    # many entries of a hash, which Spark's sizes do not count, and sides that may be read from files,
    # which are smaller than their rows: never broadcast
    found = entries(a, a_key, "a").join(entries(b, b_key, "b").hint("merge"), ["_block", "_part"])
    found = found.withColumn("_d", F.col("_va").bitwiseXOR(F.col("_vb"))).withColumn("distance", F.bit_count("_d")).where(F.col("distance") <= most)
    first, own = F.lit(len(blocks)), long(0)
    for k in reversed(range(len(blocks))):
        within = F.col("_d").bitwiseAND(long(masks[k]))
        first = F.when(F.bit_count(within) <= 2, k).otherwise(first)
        own = F.when(F.col("_ata") == k, within).otherwise(own)
    lowest = F.when(F.bit_count(own) == 2, own.bitwiseAND(F.negate(own))).otherwise(long(0))
    # no key of the join: what differs between the sides but the flips, in the block of both
    same = (F.col("_ata") - F.col("_atb") == 0) & (own.bitwiseXOR(F.col("_flipa")).bitwiseXOR(F.col("_flipb")) == 0) & (F.col("_ga").bitwiseXOR(F.col("_gb")) == 0)
    pairs = found.where(same & (first == F.col("_ata")) & (F.col("_flipa") == lowest)).select("_va", "_vb", F.col("_ga").alias("_g"), "distance")
    left = a.withColumnRenamed("_va", "_x").join(pairs.hint("merge"), [F.col("_x") == F.col("_va"), F.col("_ga") == F.col("_g")]).drop("_x", "_va", "_ga")
    both = left.join(b.withColumnRenamed("_vb", "_x").hint("merge"), [F.col("_vb") == F.col("_x"), F.col("_g") == F.col("_gb"), *(F.col(x) == F.col(y) for x, y in zip(a_key, b_key))])
    return both.drop("_x", "_vb", "_g", "_gb")


def _signed(x: int) -> int:
    """An unsigned 64-bit number as a long."""
    return x if x < 1 << 63 else x - (1 << 64)


def proximity_join(a: DataFrame, b: DataFrame, metres: float, a_key: list[str] | None = None, b_key: list[str] | None = None) -> DataFrame:
    """Rows of a and b (lat/lon in latitude_a, longitude_a, latitude_b, longitude_b), of the same key
    if one is given, within a distance: grid cells twice that size, a place on the left in its own, one
    on the right in each that its surroundings reach (four at most), then the exact distance."""
    at = lambda s, dx=0, dy=0: G.cell(F.col(f"latitude_{s}") + dx * step, F.col(f"longitude_{s}") + dy * 2 * step, 2 * metres)
    step = metres / 111_000.0  # of latitude, as in a cell
    ax, ay = at("a")
    a = a.withColumns({"_x": ax, "_y": ay}).dropna(subset=["_x", "_y"])
    around = {"_xb": F.sequence(at("b", -1, 0)[0], at("b", 1, 0)[0]), "_yb": F.sequence(at("b", 0, -1)[1], at("b", 0, 1)[1])}
    for c, cells in around.items():
        b = b.withColumn(c, F.explode(cells))
    box = (F.abs(F.col("latitude_a") - F.col("latitude_b")) <= step) & (F.abs(F.col("longitude_a") - F.col("longitude_b")) <= 2 * step)
    d = G.haversine_m(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    on = [F.col(x) == F.col(y) for x, y in zip(["_x", "_y", *(a_key or [])], ["_xb", "_yb", *(b_key or [])])]
    return a.join(b.hint("merge"), [*on, box]).withColumn("metres", d).where(F.col("metres") <= metres).drop("_x", "_y", "_xb", "_yb")


def hash_long(h: Column) -> Column:
    """A 16-digit hex hash as the long of the same bits."""
    return F.conv(h, 16, -10).cast("long")


def photo_matches(a: Column, b: Column, most: int = HASH_BITS) -> Column:
    """Greedy one-to-one over arrays of hashes as longs: each of a takes the first of b within `most`
    bits that is left. Runs over what is left of b, so a photo is compared once and parsed never."""

    def step(left, x):
        at = F.array_position(F.transform(left, lambda y: F.bit_count(x.bitwiseXOR(y)) <= most), True).cast("int")
        return F.when(at > 0, F.concat(F.slice(left, 1, at - 1), F.slice(left, at + 1, F.size(left)))).otherwise(left)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(b) - F.size(F.aggregate(a, b, step))).otherwise(0)


def gallery_match_count(a: Column, b: Column, most: int = HASH_BITS) -> Column:
    """photo_matches of arrays of hex hashes. Where one array meets many, turn each into longs once."""
    return photo_matches(F.transform(a, hash_long), F.transform(b, hash_long), most)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def cosine_clamped(a: Column, b: Column) -> Column:
    return F.least(F.greatest(cosine(a, b), F.lit(0.0)), F.lit(1.0))


def embedding_match_count(a: Column, b: Column, least: float = 0.75) -> Column:
    """Greedy one-to-one over arrays of vectors: each of a takes its best unused one of b."""

    def step(acc, x):
        seen = F.transform(F.sequence(F.lit(1), F.size(b)), lambda i: F.struct(cosine(x, F.element_at(b, i)).alias("c"), (-i).alias("i")))
        free = F.filter(seen, lambda s: ~F.array_contains(acc, -s["i"]) & (s["c"] >= least))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(-F.array_max(free)["i"]))).otherwise(acc)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.aggregate(a, F.array().cast("array<int>"), step))).otherwise(0)


def multi_hash_match(p: Column, w: Column, c: Column) -> Column:
    """Distances of the whole, wavelet and crop hashes; any of them is enough."""
    return F.coalesce(p <= 10, F.lit(False)) | F.coalesce(w <= 6, F.lit(False)) | F.coalesce(c <= 6, F.lit(False))


#: Signals of a pair: name -> value from 0 to 1. Users may pass their own.
SIGNALS: dict[str, Callable[[], Column]] = {
    "image_hash": lambda: F.least(F.coalesce(F.col("gallery_matches"), F.lit(0)), F.lit(2)) / 2.0,
    "full_postcode": lambda: F.coalesce(F.col("full_postcode_a") == F.col("full_postcode_b"), F.lit(False)).cast("double"),
    # places of latitudes so far apart are over 100 m away
    "coordinates": lambda: F.when(F.abs(F.col("latitude_a") - F.col("latitude_b")) > PLACE_M / 111_000.0, 0.0).otherwise(G.graduated_coordinate(*(F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")))),
    "street": lambda: F.coalesce((F.col("street_a") == F.col("street_b")) & (F.col("street_a") != ""), F.lit(False)).cast("double"),
    "outcode": lambda: F.coalesce(F.col("outcode_a") == F.col("outcode_b"), F.lit(False)).cast("double"),
    "price": lambda: G.graduated_price(F.col("price_pcm_a"), F.col("price_pcm_b")),
}


def match_score(pairs: DataFrame, signals: dict | None = None, weights: dict | None = None, match_at: float = MATCH_AT) -> DataFrame:
    """pairs with a column s_<signal> each, score, signal_count, is_match and tier.

    Pairs of different bedrooms score nothing. gallery_matches is optional. Signals of weight 0 add
    nothing, so they are computed only where their column is read."""
    signals, weights = signals or SIGNALS, weights or WEIGHTS
    if "gallery_matches" not in pairs.columns:
        pairs = pairs.withColumn("gallery_matches", F.lit(0))
    gate = F.coalesce(F.col("bedrooms_a") == F.col("bedrooms_b"), F.lit(False))
    pairs = pairs.withColumns({f"s_{k}": F.when(gate, f() * weights[k]).otherwise(0.0) for k, f in signals.items()})
    cols = [F.col(f"s_{k}") for k in signals if weights[k]]
    pairs = pairs.withColumns({"score": sum(cols, F.lit(0.0)), "signal_count": sum(((c > 0).cast("int") for c in cols), F.lit(0))})
    match = (F.col("score") >= match_at) & (F.col("signal_count") >= SIGNALS_AT)
    tier = F.when((F.col("score") >= 80) & (F.col("signal_count") >= 3), "high").when(match, "medium").when(F.col("score") >= 40, "low").otherwise("none")
    return pairs.withColumns({"is_match": match, "tier": tier})


def same_street() -> Column:
    return F.coalesce((F.col("street_a") == F.col("street_b")) & (F.col("street_a") != ""), F.lit(False))


def near_price(least: float = 0.0) -> Column:
    """The price signal reaches `least` (0: it fires)."""
    signal = G.graduated_price(F.col("price_pcm_a"), F.col("price_pcm_b"))
    return F.coalesce((signal >= least - 1e-9) & (signal > 0), F.lit(False))


def price_needed(weights: dict | None = None, match_at: float = MATCH_AT, texts: float = 0.0) -> float:
    """What the price signal of a match must reach if its sides share a postcode or a place, and
    neither both nor a street nor a photo. texts: what other signals may add."""
    w = weights or WEIGHTS
    return (match_at - w["outcode"] - max(w["full_postcode"], w["coordinates"]) - texts) / max(w["price"], 1e-9)


PLACE_M = 100.0  # from here on places count for nothing


def strong_pairs(df: DataFrame, block: list[str], street: bool = False, price_at: float | None = None, vetoed: bool = False, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The pairs of candidate_pairs that can reach a match: outcode, street and price alone give
    45, so a match shares its full postcode, a photo, or a place within 100 m. Selective joins in
    place of all pairs of a block; no match is lost. unique_id is a key of df.
    Photos are those in photos (an array of longs) or hashes (of texts), else the main one (photo, a
    long, or phash). street adds
    the pairs of one street, for scores in which text counts.

    With price_at (see price_needed) pairs of a postcode or place are left out that share neither
    both, nor a photo or street, and whose price signal is below it; with vetoed also those with photos
    on both sides of which none are alike.

    A pair is made where it is first found (postcode, place, street, photo) with all its columns, so
    pairs, which grow faster than records, are not shuffled; only those found by photo alone are.
    made is applied to pairs there, in place of afterwards: of many pairs little then leaves the joins."""
    made = made or (lambda pairs: pairs)
    df = stored(with_sources(df).dropna(subset=block), "records")  # else each join makes them again
    columns = df.columns
    listed = next((c for c in ("photos", "hashes") if c in columns), None)
    main = next((c for c in ("photo", "phash") if c in columns), None)
    photo = F.explode(listed) if listed else F.col(main) if main else None
    if vetoed:
        df = df.withColumn("_shown", F.coalesce(F.size(listed) > 0, F.lit(False)))
    left, right = _sides(df)
    keys = {f"{s}_key": [f"{c}_{s}" for c in block] for s in "ab"}
    of_block = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in block]
    ok = (F.col("unique_id_a") < F.col("unique_id_b")) & strangers()
    code = F.coalesce(F.col("full_postcode_a") == F.col("full_postcode_b"), F.lit(False))
    lat, lon = (F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in ("latitude", "longitude"))
    step = PLACE_M / 111_000.0
    metres = G.haversine_m(*(F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b")))
    place = F.coalesce((lat <= step) & (lon <= 2 * step) & (metres <= PLACE_M), F.lit(False))
    can = F.lit(True) if price_at is None or price_at <= 0 else same_street() | near_price(price_at) | (code & place)
    if vetoed:
        can = can & ~(F.col("_shown_a") & F.col("_shown_b"))
    named = [*(f"{c}_{s}" for s in "ab" for c in columns)]
    every = right
    if vetoed:  # of two records one has no photos: it stands on the right until the pair is turned
        right = right.where(~F.col("_shown_b"))
        ok = strangers() & ((F.col("unique_id_a") < F.col("unique_id_b")) | (F.col("_shown_a") & (F.col("unique_id_a") > F.col("unique_id_b"))))
    # files are several times smaller than the rows in them: never broadcast
    found = left.join(right.hint("merge"), [*of_block, F.col("full_postcode_a") == F.col("full_postcode_b"), ok, can]).select(named)
    placed = proximity_join(left, right, PLACE_M, **keys).where(ok & ~code & can).select(named)
    if vetoed:
        turn = F.col("unique_id_a") > F.col("unique_id_b")
        turned = [F.when(turn, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in columns]
        found, placed = found.select(turned), placed.select(turned)
        right, ok = every, (F.col("unique_id_a") < F.col("unique_id_b")) & strangers()
    found = made(found).union(made(placed))
    given = (code | place) & can
    if street:
        on_street = [F.col("street_a") == F.col("street_b"), F.col("street_a") != ""]
        found = found.union(made(left.join(right.hint("merge"), [*of_block, *on_street, ok, ~given]).select(named)))
        given = given | same_street()
    if photo is not None:
        hashes = stored(df.select("unique_id", *block, photo.alias("_hash")).where("_hash is not null"), "hashes")
        n = hashes.groupBy(*block).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n.all or 0) // HASHES_IN_TASK + 1)
        bits = min(max(((n.most or 0) // (3 * HASHES_IN_TASK)).bit_length(), 2), 10)  # 60,000 hashes of a block and its first bits
        x, y = _sides(hashes)
        near = hamming_join(x, y, "_hash_a", "_hash_b", **keys, tasks=tasks, bits=bits)
        ids = near.where("unique_id_a < unique_id_b").select("unique_id_a", "unique_id_b").distinct()
        alike = ids.join(left.hint("merge"), "unique_id_a").join(right.hint("merge"), "unique_id_b")
        found = found.union(made(alike.where(strangers() & ~given).select(named)))
    return found


def tier_counts(df: DataFrame, block: list[str], score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """tier, pairs and best score over all pairs of candidate_pairs, without listing them.

    strong_pairs are scored one by one. All other pairs share outcode, perhaps street and price
    alone, so their score follows from whether the street is the same and from the two prices, and
    they are counted: records are grouped by (street,) price and sources, groups whose prices are
    near enough to count are joined (a price has a bounded number of whole prices within 6 %), and
    the strong pairs of the same prices are taken off. Pairs of farther prices are what is left of all
    pairs, whose number follows from the sizes of the groups of sources. bedrooms and outcode are in
    the block."""
    score = score or (lambda p: match_score(with_photo(p)))
    df = stored(with_sources(df).dropna(subset=block).withColumn("sources", F.sort_array("sources")), "counted")  # read by each grouping
    same = same_street()
    lo, hi = F.least("price_pcm_a", "price_pcm_b"), F.greatest("price_pcm_a", "price_pcm_b")
    close = near_price()
    strong = score(strong_pairs(df, block)).groupBy("tier", same.alias("same"), close.alias("close"), lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"), F.max("score").alias("score"))
    strong = stored(strong, "strong")  # a row for each two prices of a tier, not for each pair
    street = F.when(F.col("street") != "", F.col("street"))

    def joined(by: list[str], near: bool) -> DataFrame:
        """lo, hi and n of the pairs of records in one group of `by`, of near prices (else of all)."""
        price = F.col("price_pcm").cast("double")
        keys = [*by, *(["price_pcm"] if near else []), "sources"]
        groups = df.withColumn("_street", street).dropna(subset=by + ["price_pcm"] * near).groupBy(*keys).agg(F.count("*").alias("n"))
        if near:  # prices within 6 % lie in one step or in neighbours
            step = F.when(price > 0, F.floor(F.log(price) / F.log(F.lit(1.0619)))).otherwise(F.lit(-1))
            groups = groups.withColumn("_step", step.cast("int"))
        a, b = _sides(groups)
        if near:
            b = b.withColumn("_step_b", F.explode(F.array(F.col("_step_b") - 1, F.col("_step_b"), F.col("_step_b") + 1)))
        on = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in [*by, *(["_step"] if near else [])]]
        once = F.struct(*(f"{c}_a" for c in keys[len(by) :])) < F.struct(*(f"{c}_b" for c in keys[len(by) :]))
        pairs = a.join(b.hint("merge"), [*on, once, strangers()]).withColumn("n", F.col("n_a") * F.col("n_b"))
        return pairs.where(close).select(lo.alias("lo"), hi.alias("hi"), "n") if near else pairs.select("n")

    one_street, n = [*block, "_street"], F.sum("n").alias("n")
    marked = lambda d, same, sign=1: d.select(F.lit(same).alias("same"), "lo", "hi", (sign * F.col("n")).alias("n"))
    of_street = stored(joined(one_street, True).groupBy("lo", "hi").agg(n), "street-prices")
    taken = strong.where("close").select("same", "lo", "hi", (-F.col("n")).alias("n"))
    near = marked(of_street, True).union(marked(of_street, False, -1)).union(marked(joined(block, True).groupBy("lo", "hi").agg(n), False)).union(taken)
    near = stored(near.groupBy("same", "lo", "hi").agg(n).where("n > 0"), "near-prices")
    all_, of_one = ((joined(by, False).agg(n).first()[0] or 0) for by in (block, one_street))
    counted = {r.same: r.n for r in near.groupBy("same").agg(n).collect()}
    known = {r.same: r.n for r in strong.groupBy("same").agg(n).collect()}
    far = [(s, total - known.get(s, 0) - counted.get(s, 0)) for s, total in ((True, of_one), (False, all_ - of_one))]
    far = df.sparkSession.createDataFrame(far, "same boolean, n long").where("n > 0").select("same", F.lit(0).alias("lo"), F.lit(1).alias("hi"), "n")
    text = lambda s: F.lit(s).cast("string")
    none = F.lit(None).cast("double")
    road = F.when(F.col("same"), "x")
    weak = near.union(far).select("n", F.col("lo").alias("price_pcm_a"), F.col("hi").alias("price_pcm_b"), *(x.alias(f"{c}_{s}") for s in "ab" for c, x in (("street", road), ("outcode", text("x")), ("full_postcode", text(None)), ("bedrooms", F.lit(1)), ("latitude", none), ("longitude", none), ("phash", text(None)))))
    every = score(weak).select("tier", "score", "n").union(strong.select("tier", "score", "n"))
    return every.groupBy("tier").agg(F.sum("n").alias("pairs"), F.max("score").alias("best"))


def gallery_veto(pairs: DataFrame) -> DataFrame:
    """Matches without those whose sides both have photos (hashes, or photos as longs) and share none."""
    listed = "hashes" if "hashes_a" in pairs.columns else "photos"
    both = F.coalesce((F.size(f"{listed}_a") > 0) & (F.size(f"{listed}_b") > 0), F.lit(False))
    return pairs.where("is_match").where(~(both & (F.col("s_image_hash") == 0)))


def rank_pairs(pairs: DataFrame, block: list[str]) -> DataFrame:
    order = Window.partitionBy(*block).orderBy(F.desc("score"), F.least("unique_id_a", "unique_id_b"), F.greatest("unique_id_a", "unique_id_b"))
    return pairs.withColumn("pair_rank", F.row_number().over(order))


def greedy_groups(pairs: list[tuple], most: int = GROUP_AT_MOST) -> dict[str, str]:
    """pairs (a, b, sources of a, sources of b), best first -> member -> first member of its group.
    Two grouped ones never merge; a group has at most `most` members and no source twice."""
    group: dict[str, str] = {}
    members: dict[str, list[str]] = {}
    sources: dict[str, set] = {}
    for a, b, sa, sb in pairs:
        if a in group and b in group:
            continue
        if a not in group and b not in group:
            group[a] = group[b] = a
            members[a], sources[a] = [a, b], {*sa, *sb}
            continue
        new, source, g = (b, sb, group[a]) if a in group else (a, sa, group[b])
        if len(members[g]) < most and sources[g].isdisjoint(source):
            group[new] = g
            members[g].append(new)
            sources[g].update(source)
    return group


ROUNDS_ABOVE = 100_000  # pairs of a component that one task may group


def group_matches(pairs: DataFrame, block: list[str] | None = None, rounds_above: int | None = None) -> DataFrame:
    """Qualifying pairs -> unique_id, group_id: best score first, then positions (first_seen, then
    unique_id). A pair touches only its two ends' groups, so each set of pairs that shares no
    record with another is on its own: a block with few pairs, else each connected component of
    pairs is a task's group; components of more pairs are grouped in rounds over the cluster."""
    limit = ROUNDS_ABOVE if rounds_above is None else rounds_above
    pa_, pb = F.struct("first_seen_a", "unique_id_a"), F.struct("first_seen_b", "unique_id_b")
    swap = pb < pa_
    first = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    sides = {"a": first("unique_id_a", "unique_id_b"), "b": first("unique_id_b", "unique_id_a"), "sa": first("sources_a", "sources_b"), "sb": first("sources_b", "sources_a"), "ta": F.least("first_seen_a", "first_seen_b"), "tb": F.greatest("first_seen_a", "first_seen_b")}
    key = F.concat_ws("|", *(F.col(f"{c}_a").cast("string") for c in block)) if block else F.lit(None).cast("string")
    rows = stored(pairs.select("score", key.alias("block"), *(c.alias(n) for n, c in sides.items())), "qualifying")
    counts = stored(rows.groupBy("block").agg(F.count("*").alias("n")), "blocks")
    fits = counts.where(F.col("block").isNotNull() & (F.col("n") <= limit)).select("block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "ta", "a", "tb", "b"], ascending=[False, True, True, True, True])
        found = greedy_groups(list(zip(pdf.a, pdf.b, pdf.sa, pdf.sb)))
        return pd.DataFrame({"unique_id": list(found), "group_id": list(found.values())}, dtype="object")

    spec = "unique_id string, group_id string"
    out = rows.join(fits, "block", "left_semi").groupBy("block").applyInPandas(run, spec)
    full = rows.join(fits, "block", "left_anti")
    if full.isEmpty():
        return out
    rooted = full.join(components(full.select("a", "b")).withColumnRenamed("node", "a"), "a")
    sizes = stored(rooted.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    small = rooted.join(sizes.where(F.col("n") <= limit).select("root"), "root", "left_semi")
    out = out.union(small.groupBy("root").applyInPandas(run, spec))
    large = sizes.where(F.col("n") > limit).select("root")
    return out if large.isEmpty() else out.union(_grouped_in_rounds(rooted.join(large, "root", "left_semi")))


def _grouped_in_rounds(pairs: DataFrame) -> DataFrame:
    """greedy_groups over the cluster. A pair that is the best of all living pairs at both its ends
    (an end is a record, or the group it is in) is not touched by any earlier one, so all such
    pairs are taken at once; pairs that can no longer be taken die. Each round is written."""
    key = F.struct((-F.col("score")).alias("s"), "ta", "a", "tb", "b")
    alive = stored(pairs.select("a", "b", "sa", "sb", key.alias("k")), "alive")
    groups = None  # group_id, members, sources
    while not alive.isEmpty():
        if groups is not None:
            for x in "ab":
                own = groups.select(F.explode("members").alias(x), F.col("group_id").alias(f"g{x}"), F.size("members").alias(f"n{x}"), F.col("sources").alias(f"all_{x}"))
                alive = alive.join(own, x, "left")
            into_a = F.col("ga").isNotNull() & F.col("gb").isNull() & (F.col("na") < GROUP_AT_MOST) & ~F.arrays_overlap("all_a", "sb")
            into_b = F.col("gb").isNotNull() & F.col("ga").isNull() & (F.col("nb") < GROUP_AT_MOST) & ~F.arrays_overlap("all_b", "sa")
            alive = alive.where((F.col("ga").isNull() & F.col("gb").isNull()) | into_a | into_b)
        else:
            alive = alive.withColumns({"ga": F.lit(None).cast("string"), "gb": F.lit(None).cast("string")})
        alive = stored(alive.select("a", "b", "sa", "sb", "k", "ga", "gb"), "alive")
        ends = alive.withColumns({"ea": F.coalesce("ga", "a"), "eb": F.coalesce("gb", "b")})
        best = ends.select(F.explode(F.array("ea", "eb")).alias("e"), "k").groupBy("e").agg(F.min("k").alias("best"))
        taken = ends.join(best.select(F.col("e").alias("ea"), F.col("best").alias("ba")), "ea").join(best.select(F.col("e").alias("eb"), F.col("best").alias("bb")), "eb")
        taken = taken.where((F.col("k") == F.col("ba")) & (F.col("k") == F.col("bb")))
        new = taken.select(
            F.coalesce("ga", "gb", "a").alias("group_id"),
            F.when(F.col("ga").isNotNull(), F.array("b")).when(F.col("gb").isNotNull(), F.array("a")).otherwise(F.array("a", "b")).alias("members"),
            F.when(F.col("ga").isNotNull(), F.col("sb")).when(F.col("gb").isNotNull(), F.col("sa")).otherwise(F.concat("sa", "sb")).alias("sources"),
        )
        both = new if groups is None else groups.unionByName(new)
        # at most GROUP_AT_MOST members
        groups = stored(both.groupBy("group_id").agg(F.flatten(F.collect_list("members")).alias("members"), F.flatten(F.collect_list("sources")).alias("sources")), "groups")
        alive = alive.drop("ga", "gb").join(taken.select("a", "b"), ["a", "b"], "left_anti")
    return groups.select(F.explode("members").alias("unique_id"), "group_id")


def first_by(value: Column, *order: Column, where: Column | None = None) -> Column:
    """The value of the first row in that order (an aggregate)."""
    key = F.struct(*order)
    return F.min_by(value, key if where is None else F.when(where, key))


# Which source's photos and floor plans are preferred, and whose floor area is trusted.
PHOTO_PRIORITY = {"zoopla": 4, "rightmove": 3, "onthemarket": 2, "openrent": 1}
AREA_TRUST = {"zoopla": 3, "onthemarket": 2, "rightmove": 1}


def ranked(source: str, ranks: dict[str, int]) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in ranks.items():
        out = out.when(F.col(source) == name, rank)
    return out.otherwise(0)


def fuse(rows: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Members (listings or golden records, with group_id) -> one golden record for each group.

    Identity is the earliest member's; the first full postcode and coordinates; sources in the
    members' order with the first URL of each; of a source's descriptions the latest that is not
    empty; the lowest and highest of the members' own lowest and highest prices; the floor area of
    the most trusted source. With images (unique_id, image_id, source, url, image_type, phash):
    the gallery, each URL once, in the members' order, where there are several members without
    photos that look like a preferred one, and the floor plan of the preferred source."""
    order = [F.col("first_seen"), F.col("unique_id")]
    has_coord = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    full = A.is_full_postcode(F.col("postcode"))
    rows = with_sources(rows)
    if "source_urls" not in rows.columns:
        rows = rows.withColumn("source_urls", F.create_map("source", "url"))
    if "descriptions" not in rows.columns:
        text = F.col("description") if "description" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("descriptions", F.when(F.trim(text) != "", F.create_map("source", text)))
    lo, hi = (F.col(c) if c in rows.columns else F.col("price_pcm") for c in ("min_price", "max_price"))
    pairs = F.transform("sources", lambda s: F.struct(s.alias("s"), F.try_element_at("source_urls", s).alias("v")))
    texts = F.coalesce(F.transform(F.map_entries("descriptions"), lambda e: F.struct(e["key"].alias("s"), e["value"].alias("v"))), F.array().cast("array<struct<s:string,v:string>>"))
    listed = F.array_sort(F.collect_list(F.struct(*order, pairs.alias("u"), texts.alias("d"))))  # at most GROUP_AT_MOST
    out = rows.groupBy("group_id").agg(
        *(first_by(F.col(c), *order).alias(c) for c in ("unique_id", "title", "price_pcm", "bedrooms", "address")),
        F.coalesce(first_by(F.col("postcode"), *order, where=full), first_by(F.col("postcode"), *order)).alias("postcode"),
        first_by(F.col("latitude"), *order, where=has_coord).alias("latitude"),
        first_by(F.col("longitude"), *order, where=has_coord).alias("longitude"),
        F.max_by("floor_area_sqm", F.when(F.col("floor_area_sqm").isNotNull(), F.struct(ranked("source", AREA_TRUST).alias("t"), (-F.unix_timestamp("first_seen")).alias("s"), F.col("unique_id")))).alias("floor_area_sqm"),
        F.min(lo).alias("min_price"),
        F.max(hi).alias("max_price"),
        F.min("first_seen").alias("first_seen"),
        F.count("*").alias("members"),
        listed.alias("_m"),
    )
    urls, said = F.flatten(F.transform("_m", lambda m: m["u"])), F.flatten(F.transform("_m", lambda m: m["d"]))
    named = lambda x: F.array_distinct(F.transform(x, lambda e: e["s"]))
    pick = lambda x, at: F.map_from_entries(F.transform(named(x), lambda s: F.struct(s.alias("k"), F.element_at(F.filter(x, lambda e: e["s"] == s), at)["v"].alias("v"))))
    out = out.withColumns({"sources": named(urls), "source_urls": pick(urls, 1), "descriptions": pick(said, -1)}).drop("_m")
    if images is None:
        return out
    own = images.join(rows.select("unique_id", "group_id", "first_seen").hint("merge"), "unique_id").withColumn("priority", ranked("source", PHOTO_PRIORITY))
    once = Window.partitionBy("group_id", "image_type", "url").orderBy("first_seen", "unique_id", "image_id")
    own = own.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    gallery = own.where("image_type = 'gallery'").withColumn("place", F.struct("first_seen", "unique_id", "image_id")).select("group_id", "place", "url", "phash", "priority")
    # a record of its own keeps its gallery as it is
    merged = rows.groupBy("group_id").agg(F.count("*").alias("_n")).where("_n > 1").select("group_id").hint("merge")  # rows may be read from files, which are smaller than they
    kept = perceptual_dedup(gallery.join(merged, "group_id", "left_semi")).union(gallery.join(merged, "group_id", "left_anti"))
    photos = kept.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", "url")))["url"].alias("images"))
    plans = own.where("image_type = 'floorplan'").groupBy("group_id").agg(F.max_by("url", F.struct("priority", (-F.unix_timestamp("first_seen")).alias("t"), (-F.col("image_id")).alias("i"))).alias("floorplan"))
    return out.join(photos, "group_id", "left").join(plans, "group_id", "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def with_hashes(df: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """hashes: of the gallery in images (unique_id, image_id, image_type, phash), else of the main
    photo; null where there is neither."""
    main = F.when(F.col("phash").isNotNull(), F.array("phash")) if "phash" in df.columns else F.lit(None).cast("array<string>")
    if images is None:
        return df.withColumn("hashes", main)
    gallery = images.where("image_type = 'gallery' and phash is not null").groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("image_id", "phash")))["phash"].alias("_g"))
    return df.join(gallery, "unique_id", "left").withColumn("hashes", F.coalesce("_g", main)).drop("_g")


def qualifying_pairs(df: DataFrame, block: list[str], images: DataFrame | None = None) -> DataFrame:
    """The scored pairs of listings that may be grouped: matches that the gallery veto leaves."""
    slim = with_hashes(with_sources(keyed(df)), images).select("unique_id", "sources", "price_pcm", "bedrooms", "outcode", "street", "full_postcode", "latitude", "longitude", "first_seen", "hashes")
    slim = slim.withColumn("photos", F.transform("hashes", hash_long)).drop("hashes")
    pairs = strong_pairs(slim, block, price_at=price_needed(), vetoed=True).withColumn("gallery_matches", photo_matches(F.col("photos_a"), F.col("photos_b")))
    return gallery_veto(match_score(pairs))


def grouped(df: DataFrame, groups: DataFrame) -> DataFrame:
    """df with group_id (a record of no group is its own), written once: grouping runs in Python, and
    what follows reads the rows several times."""
    return stored(df.join(groups.hint("merge"), "unique_id", "left").withColumn("group_id", F.coalesce("group_id", "unique_id")), "members")


def resolve_entities(df: DataFrame, block: tuple[str, ...] = ("outcode", "bedrooms"), images: DataFrame | None = None) -> DataFrame:
    """Listings (or golden records) and their photos -> golden records: earliest row of each id,
    strong pairs, score, gallery veto, grouping, fusion. Without images each has its main photo
    only, and the result no galleries."""
    one = Window.partitionBy("unique_id").orderBy("first_seen", "url")
    df = df.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    groups = group_matches(qualifying_pairs(df, list(block), images), list(block))
    return fuse(grouped(df, groups), images)


def with_photo(pairs: DataFrame) -> DataFrame:
    """gallery_matches of the single main photo, where both sides have a hash (photo, as main_photo
    gives it, else phash)."""
    if "photo_a" in pairs.columns:
        return pairs.withColumn("gallery_matches", F.coalesce((F.bit_count(F.col("photo_a").bitwiseXOR(F.col("photo_b"))) <= HASH_BITS).cast("int"), F.lit(0)))
    if "phash_a" not in pairs.columns:
        return pairs
    return pairs.withColumn("gallery_matches", F.coalesce((hamming(F.col("phash_a"), F.col("phash_b")) <= HASH_BITS).cast("int"), F.lit(0)))


def best_urls(results: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_match: results and anchors (id, source_urls) that share a URL; each result takes its
    first anchor and each anchor serves one result."""
    x = results.select(F.col("id").alias("result"), F.explode(F.map_values("source_urls")).alias("url"))
    y = anchors.select(F.col("id").alias("anchor"), F.explode(F.map_values("source_urls")).alias("url"))
    hits = x.join(y, "url").select("result", "anchor").distinct()
    for key, other in (("result", "anchor"), ("anchor", "result")):
        w = Window.partitionBy(key).orderBy(other)
        hits = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return hits


def perceptual_dedup(images: DataFrame) -> DataFrame:
    """images (group_id, place, url, phash, priority) without those that look like another of their
    group: of two alike the one of higher priority stays, the earlier place of equals. A photo that
    has been dropped drops no further one. Groups are the photos of a few listings."""
    rest = [c for c in images.columns if c not in ("group_id", "place")]
    row = F.struct("place", *rest, hash_long(F.col("phash")).alias("_h"))
    groups = images.groupBy("group_id").agg(F.sort_array(F.collect_list(row)).alias("_t"))
    at = lambda i: F.element_at("_t", i)

    def step(gone: Column, i: Column) -> Column:
        later = F.slice("_t", i + 1, F.size("_t"))
        alike = F.transform(later, lambda x, k: F.when(F.bit_count(x["_h"].bitwiseXOR(at(i)["_h"])) <= HASH_BITS, F.struct((i + k + 1).alias("j"), x["priority"].alias("p"))))
        met = F.filter(alike, lambda x: x.isNotNull() & ~F.array_contains(gone, x["j"]))
        better = F.filter(met, lambda x: x["p"] > at(i)["priority"])
        # those before the first better one go, and with it the photo itself
        lost = F.when(F.size(better) > 0, F.concat(F.filter(met, lambda x: x["j"] < better[0]["j"])["j"], F.array(i))).otherwise(met["j"])
        return F.when(F.array_contains(gone, i), gone).otherwise(F.concat(gone, lost))

    gone = F.aggregate(F.sequence(F.lit(1), F.size("_t")), F.array().cast("array<int>"), step)
    kept = groups.withColumn("_gone", gone).select("group_id", F.explode(F.filter("_t", lambda x, k: ~F.array_contains("_gone", k + 1))).alias("_x"))
    return kept.select("group_id", "_x.*").select(images.columns)


def token_ratio(kind: str) -> Callable[[Column, Column], Column]:
    """token_sort or token_set similarity of two texts (share of common subsequence), 0 to 1. The
    length of the longest common subsequence is taken with a bit for each place of the left text."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType

    def common(a: str, b: str) -> float:
        if not a and not b:
            return 1.0
        places: dict[str, int] = {}
        for i, x in enumerate(a):
            places[x] = places.get(x, 0) | 1 << i
        full = free = (1 << len(a)) - 1
        for y in b:
            hit = free & places.get(y, 0)
            free = (free + hit | free - hit) & full
        return 2 * (len(a) - free.bit_count()) / (len(a) + len(b))

    def one(a: str | None, b: str | None) -> float:
        p, q = sorted((a or "").lower().split()), sorted((b or "").lower().split())
        if kind == "sort":
            return common(" ".join(p), " ".join(q))
        both, p, q = sorted({*p} & {*q}), sorted({*p} - {*q}), sorted({*q} - {*p})
        if both and (not p or not q):
            return 1.0
        base = " ".join(both)
        left, right = " ".join(both + p), " ".join(both + q)
        return max(common(left, right), *((common(base, left), common(base, right)) if both else (0.0,)))

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pandas_udf(run, DoubleType())
