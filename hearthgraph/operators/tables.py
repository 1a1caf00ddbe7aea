"""Table maintenance: upserts by policy, deletes, retention, JSON columns, audits.

There is no table format here: an operator takes the present snapshot and gives the next one;
publish() writes it under a new version and only then names that version as the current one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICIES = ("replace", "coalesce_new", "keep", "increment", "max", "min")


def _policy(policy: str, old: Column, new: Column) -> Column:
    return {
        "replace": new,
        "coalesce_new": F.coalesce(new, old),
        "keep": old,
        "increment": F.coalesce(old, F.lit(0)) + 1,
        "max": F.greatest(old, new),
        "min": F.least(old, new),
    }[policy]


def merge_upsert(target: DataFrame, updates: DataFrame, key: list[str], policy: dict[str, str], default: str = "replace", guard: Column | None = None) -> DataFrame:
    """Keyed upsert; each column by its policy where the key exists, inserted as it is where not.

    updates has one row for each key. A guard (over the target's columns) protects rows for which
    it does not hold."""
    cols = target.columns
    new = updates.select(*key, *(F.col(c).alias(f"_new_{c}") for c in updates.columns if c not in key), F.lit(True).alias("_u"))
    old = target.withColumn("_t", F.lit(True)).withColumn("_g", F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))
    both = old.join(new, key, "full_outer")
    out = []
    for c in cols:
        if c in key or c not in updates.columns:
            out.append(F.col(c))
            continue
        old_c, new_c = F.col(c), F.col(f"_new_{c}")
        merged = F.when(F.col("_t").isNull(), new_c).when(F.col("_u").isNull() | ~F.col("_g"), old_c).otherwise(_policy(policy.get(c, default), old_c, new_c))
        out.append(merged.alias(c))
    return both.select(out)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    new = rows.dropDuplicates(key).join(target.select(key), key, "left_anti")
    return target.unionByName(new.select(target.columns))


def delete_cascade(parent: DataFrame, ids: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], unlinked: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """parent and children without the ids; in unlinked tables the reference becomes null."""
    gone = ids.select(F.col(key).alias("_id")).distinct()
    out = {"parent": parent.join(gone, F.col(key) == F.col("_id"), "left_anti")}
    for name, (df, c) in children.items():
        out[name] = df.join(gone, F.col(c) == F.col("_id"), "left_anti")
    for name, (df, c) in unlinked.items():
        out[name] = df.join(gone, F.col(c) == F.col("_id"), "left").withColumn(c, F.when(F.col("_id").isNull(), F.col(c))).drop("_id")
    return out


def append_events(events: DataFrame, path: str, meta: list[str]) -> None:
    """Append, the named columns as JSON text, in a folder for each run."""
    keep = [c for c in events.columns if c not in meta]
    events.select(*keep, F.to_json(F.struct(*meta)).alias("metadata_json")).write.mode("append").partitionBy("run_id").parquet(path)


def retain_last_runs(events: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """Events of the last n runs (run_id, started_at): n rows, so a semi-join may broadcast them."""
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n).select("run_id")
    return events.join(F.broadcast(last), "run_id", "left_semi")


def encode_json(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def decode_json(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """JSON text -> array or map; null and unreadable text -> empty."""
    empty = lambda t: F.array().cast(t) if t.startswith("array") else F.create_map().cast(t)
    return df.withColumns({c: F.coalesce(F.from_json(c, t), empty(t)) for c, t in schema.items()})


def dedupe_json_array(c: Column) -> Column:
    """Distinct items of a JSON array of strings, in the order of their first place."""
    return F.to_json(F.array_distinct(F.from_json(c, "array<string>")))


def rebuild_golden(rows: DataFrame) -> DataFrame:
    """Listings of each merged_id: sources by last_seen, of each the last URL and the last
    description that is not empty, lowest and highest price."""
    at = F.struct("last_seen", "unique_id")
    text = F.max_by("description", F.when(F.trim("description") != "", at))
    per = rows.where("merged_id is not null").groupBy("merged_id", "source").agg(F.max_by("url", at).alias("url"), text.alias("text"), F.min("last_seen").alias("at"), F.min("price_pcm").alias("lo"), F.max("price_pcm").alias("hi"), F.count("*").alias("n"))
    # a source is one row, so a record's list is as short as the list of sources
    out = per.groupBy("merged_id").agg(F.array_sort(F.collect_list(F.struct("at", "source", "url", "text"))).alias("x"), F.min("lo").alias("min_price"), F.max("hi").alias("max_price"), F.sum("n").alias("n"))
    named = lambda c, x: F.map_from_entries(F.transform(x, lambda s: F.struct(s["source"], s[c])))
    return out.select("merged_id", F.col("x.source").alias("sources"), named("url", F.col("x")).alias("source_urls"), named("text", F.filter("x", lambda s: s["text"].isNotNull())).alias("descriptions"), "min_price", "max_price", "n")


def rows_to_golden(golden: DataFrame, listings: DataFrame) -> DataFrame:
    """golden (unique_id, price_pcm, min_price, max_price and JSON columns sources_json,
    source_urls_json, descriptions_json) with sources, source_urls, descriptions and prices rebuilt
    from the listings that point to it, or read from its own columns where none does."""
    own = rebuild_golden(listings).select(F.col("merged_id").alias("unique_id"), *(F.col(c).alias(f"_{c}") for c in ("sources", "source_urls", "descriptions", "min_price", "max_price")))
    texts = "map<string,string>"
    read = decode_json(golden.select("*", *(F.col(f"{c}_json").alias(c) for c in ("sources", "source_urls", "descriptions"))), {"sources": "array<string>", "source_urls": texts, "descriptions": texts})
    out = read.join(own, "unique_id", "left")
    prices = {c: F.coalesce(f"_{c}", c, "price_pcm") for c in ("min_price", "max_price")}
    lists = {c: F.coalesce(f"_{c}", c) for c in ("sources", "source_urls", "descriptions")}
    return out.withColumns(prices | lists).select(*golden.columns, "sources", "source_urls", "descriptions")


def backfill_listings(golden: DataFrame, aliases: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """golden (unique_id, source, url, sources_json, urls_json) and aliases (unique_id, source,
    anchor_id) -> the listing rows (unique_id, source, url, merged_id, phase) that are not in
    listings yet: each record's own, then those of its aliases (with the record's URL where the
    JSON names none for the source), then the sources that only the JSON names with a URL, under
    source:url. Of equal ids the first phase counts."""
    urls = F.from_json("urls_json", "map<string,string>")
    own = golden.select("unique_id", "source", "url", F.col("unique_id").alias("merged_id"), F.lit(1).alias("phase"))
    anchor = golden.select(F.col("unique_id").alias("anchor_id"), F.col("url").alias("_url"), urls.alias("_urls"))
    second = aliases.join(anchor, "anchor_id").select("unique_id", "source", F.coalesce(F.try_element_at("_urls", F.col("source")), "_url").alias("url"), F.col("anchor_id").alias("merged_id"), F.lit(2).alias("phase"))
    many = golden.withColumn("_s", F.from_json("sources_json", "array<string>")).where(F.size("_s") > 1)
    third = many.select(F.col("unique_id").alias("merged_id"), F.explode(F.array_distinct("_s")).alias("s"), F.col("source").alias("_own"), urls.alias("_urls")).where("s <> _own")
    third = third.withColumn("url", F.try_element_at("_urls", F.col("s"))).where("url <> ''").select(F.concat_ws(":", "s", "url").alias("unique_id"), F.col("s").alias("source"), "url", "merged_id", F.lit(3).alias("phase"))
    w = Window.partitionBy("unique_id").orderBy("phase", "merged_id")
    out = own.union(second).union(third).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out if listings is None else out.join(listings.select("unique_id"), "unique_id", "left_anti")


def orphans(images: DataFrame, files: DataFrame, records: DataFrame, key: str = "cache_name") -> tuple[DataFrame, DataFrame]:
    """files (folder, key): those that no image names, and the folders that no record has."""
    lost = files.distinct().join(images.select(key).distinct().hint("merge"), key, "left_anti")
    folders = files.select("folder").distinct().join(records.select(F.col("unique_id").alias("folder")).hint("merge"), "folder", "left_anti")
    return lost, folders


def image_audit(images: DataFrame, files: DataFrame, key: str = "cache_name") -> DataFrame:
    """Missing files by listing and type; loses_all if a listing has no photo left."""
    seen = images.join(files.select(key).distinct().withColumn("_f", F.lit(1)).hint("merge"), key, "left")
    return seen.groupBy("unique_id").agg(
        F.count("*").alias("images"),
        *(F.sum(F.when((F.col("image_type") == t) & F.col("_f").isNull(), 1).otherwise(0)).alias(f"missing_{t}") for t in ("gallery", "floorplan")),
        (F.count("_f") == 0).alias("loses_all"),
    )


def gallery_coverage(images: DataFrame, files: DataFrame, cap: int, key: str = "cache_name") -> DataFrame:
    """Of the first images that a listing should have (cap, less one for its floor plan), how many
    have a file; partial if some are missing."""
    plan = images.groupBy("unique_id").agg(F.max((F.col("image_type") == "floorplan").cast("int")).alias("plan"))
    w = Window.partitionBy("unique_id").orderBy("image_id")
    gallery = images.where("image_type = 'gallery'").withColumn("_n", F.row_number().over(w)).join(plan, "unique_id").where(F.col("_n") <= cap - F.col("plan"))
    hit = gallery.join(files.select(key).distinct().withColumn("_f", F.lit(1)), key, "left")
    out = hit.groupBy("unique_id").agg(F.count("*").alias("expected"), F.count("_f").alias("cached"))
    return out.withColumn("partial", F.col("cached") < F.col("expected"))


def stale(df: DataFrame, column: str, version: int) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) != version))


def recompute_stale(df: DataFrame, column: str, version: int, score: Callable[[DataFrame], DataFrame], key: str = "unique_id") -> DataFrame:
    """The next snapshot of df: rows of another version with their scores anew (score: rows ->
    key and the new columns), and that version; others as they are."""
    new = score(stale(df, column, version)).withColumn(column, F.lit(version))
    return merge_upsert(df, new, [key], {})


def publish(df: DataFrame, root: str, version: int, note: str = "") -> None:
    """Write a snapshot; readers follow the newest version that was finished (its _SUCCESS). The
    note (who wrote it) is written before, beside it."""
    spark = df.sparkSession
    if note:
        spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_notes/{version}")
    df.write.mode("overwrite").parquet(f"{root}/version={version:010d}")


def note(spark: SparkSession, root: str, version: int) -> str | None:
    """The note of a version, if it has one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_notes/{version}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{root}/_notes/{version}").first().note


def versions(spark: SparkSession, root: str) -> list[int]:
    """The finished versions under root, in order; none where there is no such folder."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(new(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(new(root))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(new(f"{root}/{n}/_SUCCESS")))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished snapshot under root."""
    return spark.read.parquet(f"{root}/version={versions(spark, root)[-1]:010d}")
