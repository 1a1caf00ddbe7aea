"""Changes over time: prices, statuses, failures, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_changes(obs: DataFrame, key: str = "entity", order: tuple[str, ...] = ("ts", "obs_id")) -> DataFrame:
    """An old price, a new one and the difference wherever an observation differs from the one
    before; the first observation gives nothing."""
    old = F.lag("price").over(Window.partitionBy(key).orderBy(*order))
    out = obs.withColumn("old_price", old).where(F.col("old_price") != F.col("price"))
    return out.select(key, *order, "old_price", F.col("price").alias("new_price"), (F.col("price") - F.col("old_price")).alias("change"))


def latest_change(changes: DataFrame, key: str = "entity") -> DataFrame:
    at = F.struct("ts", "obs_id")
    return changes.groupBy(key).agg(F.max_by("change", at).alias("last_change"), F.max("ts").alias("changed_at"))


def latest_unsent_drop(changes: DataFrame, listings: DataFrame, key: str = "entity") -> DataFrame:
    """The newest drop (rises do not count) of each sent listing that was not told of one."""
    drops = changes.where("change < 0").groupBy(key).agg(F.max_by(F.struct("old_price", "new_price", "change"), F.struct("ts", "obs_id")).alias("d"))
    todo = listings.where("notification_status = 'sent' and not told").select(key)
    return todo.join(drops, key).select(key, "d.*")


def consecutive_failures(events: DataFrame, key: str, order: list[str], failed: Column, k: int) -> DataFrame:
    """events with streak (failures since the last success) and skipped (after the k-th in a row)."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(w)
    rows = events.withColumns({"_f": failed, "_i": island})
    streak = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(key, "_i").orderBy(*order))
    rows = rows.withColumn("streak", F.when(F.col("_f"), streak).otherwise(0))
    tripped = F.max((F.col("streak") >= k).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("skipped", F.coalesce(tripped == 1, F.lit(False))).drop("_f", "_i")


def status_transitions(log: DataFrame, key: str, status: str, order: list[str], first: str = "new") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("from_status", F.lag(status, 1, first).over(w)).withColumnRenamed(status, "to_status")


def off_market_intervals(log: DataFrame, key: str, order: list[str], off: Column, reason: str, ts: str) -> DataFrame:
    """A row for each stretch off the market: when it went (kept while it stays off), when it came
    back (null if it has not), and the reason it went."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("_off", off).withColumn("_was", F.lag("_off", 1, False).over(w)).where(F.col("_off") != F.col("_was"))
    rows = rows.withColumn("back_at", F.lead(ts).over(w))
    return rows.where("_off").select(key, F.col(ts).alias("off_at"), "back_at", F.col(reason).alias("reason"))


def early_stop(pages: DataFrame, rows: DataFrame, key: list[str], page: str, item: str, known: Column) -> DataFrame:
    """The new rows that reading page after page gives. pages (key, page, failed); rows (key, page,
    item, ...). Reading ends before the first page that is empty, whose items are all known, or
    that has no item that earlier pages have not; a failed page is passed over. An item counts on
    its first page only."""
    read = pages.where("not failed").select(*key, page).distinct()
    first = Window.partitionBy(*key, item)
    own = rows.join(read, [*key, page], "left_semi").withColumns({"_known": known, "_first": F.min(page).over(first)})
    per = read.join(own.groupBy(*key, page).agg(F.bool_and("_known").alias("_old"), F.bool_or(F.col("_first") == F.col(page)).alias("_fresh")), [*key, page], "left")
    stop = per.where("_old is null or _old or not _fresh").groupBy(*key).agg(F.min(page).alias("_stop"))
    kept = own.join(stop, key, "left").where((F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))) & (F.col("_first") == F.col(page)))
    return kept.drop("_stop", "_known", "_first")


def run_durations(runs: DataFrame) -> DataFrame:
    return runs.withColumn("seconds", F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))


def last_run(runs: DataFrame) -> DataFrame:
    return runs.where("completed_at is not null").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"), F.max("started_at").alias("started_at"))


def unsent_drops(listings: DataFrame, changes: DataFrame, key: str = "entity") -> DataFrame:
    """Each sent, untold listing with its whole latest drop, as one row of both tables."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("obs_id"))
    rows = listings.where("notification_status = 'sent' and not told").join(changes.where("change < 0"), key)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
