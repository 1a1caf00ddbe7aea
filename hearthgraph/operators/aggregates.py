"""Per-source, per-group and per-run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in that order; ranks are cut before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_source(df: DataFrame, n: int, source: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def budget_cap(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """df with deferred: false for the first n rows in the order. The n-th place is a top list's
    last row, so nothing is ranked in one task."""
    key = F.struct(*order)
    last = df.select(key.alias("k")).orderBy("k").limit(n).agg(F.max("k").alias("last"))
    return df.crossJoin(F.broadcast(last)).withColumn("deferred", F.coalesce(key > F.col("last"), F.lit(True))).drop("last")


def wrap_single(df: DataFrame) -> DataFrame:
    """A listing as a golden record of one source."""
    return df.select("unique_id", F.array("source").alias("sources"), F.create_map("source", "url").alias("source_urls"), F.col("price_pcm").alias("min_price"), F.col("price_pcm").alias("max_price"))


def best_by_priority(value: Column, priority: Column, place: Column) -> Column:
    """The non-null value of highest priority, the earliest of equals (an aggregate)."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(priority.alias("p"), (-place).alias("at"))))


def longest_text(text: Column, place: Column) -> Column:
    """The longest text, the first of equals (an aggregate)."""
    return F.max_by(text, F.struct(F.char_length(text).alias("n"), (-place).alias("at")))


def best_commute(times: DataFrame, most: int) -> DataFrame:
    """id, mode, minutes -> the quickest mode within the limit, in order of mode if equal."""
    ok = times.where(F.col("minutes") <= most)
    return ok.groupBy("id").agg(F.min("minutes").alias("minutes"), F.min_by("mode", F.struct("minutes", "mode")).alias("mode"))


def commute_summary(times: DataFrame, most: int) -> DataFrame:
    """mode, tried (ids with a time), within (ids within the limit) and chosen (ids whose quickest
    mode it is), and a row of mode 'all' for the ids of any mode."""
    best = best_commute(times, most).select("id", F.col("mode").alias("_best"))
    rows = times.join(best, "id", "left").select("id", F.explode(F.array("mode", F.lit("all"))).alias("mode"), "minutes", "_best")
    hit = F.col("minutes") <= most
    chosen = F.coalesce((F.col("_best") == F.col("mode")) | ((F.col("mode") == "all") & F.col("_best").isNotNull()), F.lit(False))
    ids = rows.groupBy("mode", "id").agg(F.count("minutes").alias("_t"), F.bool_or(F.coalesce(hit, F.lit(False))).alias("_w"), F.bool_or(chosen).alias("_c"))
    return ids.groupBy("mode").agg(F.count_if(F.col("_t") > 0).alias("tried"), F.count_if("_w").alias("within"), F.count_if("_c").alias("chosen"))


def derive_off_market(checks: DataFrame) -> DataFrame:
    """checks (id, pos, status, was_off) -> off, returned and reason. All sources gone: off, with
    the first one's reason. Any active and it was off: returned. An unknown blocks going off."""
    gone = F.col("status").isin("removed", "let_agreed")
    out = checks.groupBy("id").agg(
        F.bool_and(gone).alias("all_gone"),
        F.bool_or(F.col("status") == "active").alias("any_active"),
        F.bool_or("was_off").alias("was"),
        F.min_by("status", F.when(gone, F.col("pos"))).alias("reason"),
    )
    return out.select("id", (F.col("all_gone") & ~F.col("was")).alias("off"), (F.col("any_active") & F.col("was")).alias("returned"), F.when(F.col("all_gone"), F.col("reason")).alias("reason"))


def funnel(rows: DataFrame, stages: list[str], run: str = "run_id", ts: str | None = None) -> DataFrame:
    """Different items of each stage of each run, and what share the stage before kept. With a time
    column, the seconds from a stage's first row to its last as well (null for a stage without rows)."""
    counts = F.countDistinct("item")
    if ts:
        seconds = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6
        out = rows.groupBy(run).pivot("stage", stages).agg(counts.alias("n"), seconds.alias("seconds"))
        out = out.withColumnsRenamed({f"{x}_n": x for x in stages})
    else:
        out = rows.groupBy(run).pivot("stage", stages).agg(counts)
    out = out.fillna(0, subset=stages)
    kept = [F.coalesce(F.try_divide(F.col(b), F.col(a)), F.lit(0.0)).alias(f"{b}_share") for a, b in zip(stages, stages[1:])]
    return out.select("*", *kept)


def scraper_health(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("run_id", "source").agg(F.sum("pages").alias("pages"), F.sum("errors").alias("errors"))
    return out.withColumn("healthy", (F.col("pages") > 0) & (F.col("errors") == 0))


def rent_benchmarks(df: DataFrame, least: int = 3) -> DataFrame:
    out = df.groupBy("outcode", "bedrooms").agg(F.percentile("price_pcm", 0.5).alias("median"), F.avg("price_pcm").alias("mean"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


# Dollars for each million tokens of each kind.
TOKEN_PRICES = {"input": 3.0, "output": 15.0, "cache_read": 0.30, "cache_write": 3.75}


def token_cost(calls: DataFrame) -> DataFrame:
    total = [F.sum(k).alias(k) for k in TOKEN_PRICES]
    cost = sum((F.col(k) * p for k, p in TOKEN_PRICES.items()), F.lit(0.0)) / 1e6
    return calls.groupBy("run_id").agg(*total).withColumn("cost", cost)


def largest_variant(images: DataFrame, n: int | None = None) -> DataFrame:
    """For each photo (key) the variant of most pixels, the first of equals; with n, the n largest
    photos of each listing."""
    out = images.groupBy("unique_id", "photo").agg(F.max_by("url", F.struct((F.col("width") * F.col("height")).alias("px"), (-F.col("image_id")).alias("at"))).alias("url"), F.max(F.col("width") * F.col("height")).alias("pixels"))
    if n is None:
        return out
    w = Window.partitionBy("unique_id").orderBy(F.desc("pixels"), "photo")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
