"""Streaming forms of the stateful operators; the batch operators are their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthgraph.operators import tables as U
from hearthgraph.streaming.ordered import in_order


def upsert_into(root: str, key: list[str], policy: dict[str, str], order: list[str], stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge a batch into the newest finished snapshot under root and publish the
    next; of a key's rows in a batch the last in `order` counts, and with a policy columns follow
    it. Where no snapshot stands yet, the batch begins the table.

    The stream's batch number is part of a snapshot's name: a batch that is run again finds its
    own snapshot (finished) and does nothing, so repeating it changes nothing; a stream begun anew
    over a table goes on from what stands there."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(*key).agg(*(F.max_by(c, F.struct(*order)).alias(c) for c in batch.columns if c not in key)).select(batch.columns)
        done = U.versions(spark, root)
        if done and U.note(spark, root, done[-1]) == f"{stream}:{number}":
            return
        new = U.merge_upsert(U.current(spark, root), last, key, policy) if done else last
        U.publish(new, root, (done[-1] if done else 0) + 1, f"{stream}:{number}")

    return merge


def price_changes(obs: DataFrame, key: str = "entity", delay: str = "365 days", forget: str | None = None) -> DataFrame:
    """A row for each change of price: the key's observations in order of time, however they arrive
    within the delay. State of a key: its last price. A key that gives no observation for `forget`
    (else for the delay) is forgotten, so that state follows the living keys."""

    def take(before: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        _, i, price = row
        if price is None:
            return before or (None,), None
        old = before[0] if before else None
        return (price,), (i, old, price, price - old) if old is not None and old != price else None

    return in_order(obs, key, "ts", "obs_id", {"price": "int"}, "obs_id long, old_price int, new_price int, change int", take, None, delay, forget)


def seen_filter(listings: DataFrame, seen: DataFrame, key: str = "unique_id", ts: str = "first_seen", delay: str = "1 hour") -> DataFrame:
    """First row of each id within the watermark, without ids already promoted (a static table)."""
    fresh = listings.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return fresh.join(seen.where("merged_id is not null").select(key).distinct(), key, "left_anti")


def breaker(events: DataFrame, key: str, k: int, cooldown_s: int, delay: str = "365 days", forget: str | None = None) -> DataFrame:
    """key, event_id, state: closed, open (skipped) or half_open (a try after the cooldown), for a
    key's events in order of time, however they arrive within the delay. State of a key: failures in
    a row, and when it opened. A key that is silent for `forget` (else for the delay) is forgotten,
    and closed when it comes again."""

    def take(before: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        streak, opened = before or (0, -1)
        at, i, failed = row
        t = at // 1_000_000
        if opened >= 0 and t - opened < cooldown_s:
            return (streak, opened), (i, "open")
        name = "half_open" if opened >= 0 else "closed"
        if not failed:
            return (0, -1), (i, name)
        return (streak + 1, t if opened >= 0 or streak + 1 >= k else -1), (i, name)

    return in_order(events, key, "ts", "event_id", {"failed": "boolean"}, "event_id long, state string", take, None, delay, forget)


def off_market_intervals(log: DataFrame, key: str, row_id: str, off: Column, reason: str, delay: str, forget: str | None = None) -> DataFrame:
    """key, off_at, back_at and reason of each stretch off the market, for a log (key, ts, row_id,
    reason) in any order within the delay. A stretch comes out when the status that ends it has come
    and the watermark has passed it; one that nothing ends for `forget` (else for the delay) comes out
    with back_at null. State of a key: when and why it went off. Times are microseconds since 1970."""

    def take(before: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        at, _, gone, why = row
        since, reason = before or (None, None)
        if since is None:
            return (at, why) if gone else (None, None), None
        return ((since, reason), None) if gone else ((None, None), (since, at, reason))

    def close(before: tuple) -> tuple | None:
        return (before[0], None, before[1]) if before[0] is not None else None

    rows = log.select(key, "ts", row_id, off.alias("_off"), F.col(reason).alias("_reason"))
    return in_order(rows, key, "ts", row_id, {"_off": "boolean", "_reason": "string"}, "off_at long, back_at long, reason string", take, close, delay, forget)


def funnel(events: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts of each stage in tumbling or sliding windows of event time. In append mode a window
    comes out once, when the watermark has passed its end, and its state goes."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Stretches of a key's events with no gap as long as `gap`; in append mode each comes out when
    the watermark has passed its end."""
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def close_with(df: DataFrame, ts: str, at: str) -> DataFrame:
    """A stream's rows of one last moment, in the columns of df (all else null): what a watermark
    needs to pass everything before it when a stream ends."""
    return df.withColumns({c: (F.lit(at).cast("timestamp") if c == ts else F.lit(None).cast(k)) for c, k in df.dtypes})


def drain(df: DataFrame, out: str, mode: str = "append", done: set[int] | None = None) -> DataFrame:
    """Run a stream over all that is there and give what it put out: all batches, or for complete
    output the last one. Run again over the same folder it goes on from where it stopped; `done`
    carries the numbers of the batches from run to run."""
    batches = set() if done is None else done

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number:06d}")
        batches.add(number)

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    paths = [f"{out}/data/batch={n:06d}" for n in sorted(batches)]
    return spark.read.schema(df.schema).parquet(*(paths if mode == "append" else paths[-1:]))
