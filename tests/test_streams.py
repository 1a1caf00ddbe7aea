"""Streams of rows out of order, batch by batch, against the batch operators."""

import datetime
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthgraph.operators import history as H
from hearthgraph.streaming import streams as R

DAY = datetime.datetime(2025, 1, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


class Feed:
    """A folder that a stream reads; each add() runs the stream to the end of it, from its checkpoint."""

    def __init__(self, spark, tmp, kind, build):
        self.spark, self.root, self.out, self.kind, self.build = spark, f"{tmp}/in-{uuid.uuid4().hex}", f"{tmp}/out-{uuid.uuid4().hex}", kind, build
        self.done, self.seen = set(), Counter()

    def add(self, *rows):
        """What comes out anew."""
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(self.root)
        stream = self.spark.readStream.schema(self.kind).parquet(self.root)
        got = Counter(tuple(r) for r in R.drain(self.build(stream), self.out, done=self.done).collect())
        new, self.seen = got - self.seen, got
        return sorted(new.elements(), key=str)


PRICES = "entity long, obs_id long, ts timestamp, price int"


def test_rows_wait_for_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path, PRICES, lambda s: R.price_changes(s, delay="10 hours", forget="100 hours"))
    assert feed.add((1, 1, at(0), 100), (1, 3, at(8), 120)) == []
    # obs 2 came late, but the watermark (hour -2) has not passed it; hour 11 moves the watermark to 1
    assert feed.add((1, 2, at(4), 110), (2, 9, at(11), 50)) == []
    assert feed.add((2, 10, at(20), 60)) == [(1, 2, 100, 110, 10), (1, 3, 110, 120, 10)]
    # hour 9 is before the watermark (10): too late, it changes nothing; equal times go by id
    assert feed.add((1, 4, at(9), 999), (1, 6, at(21), 90), (1, 5, at(21), 80)) == []
    assert feed.add((3, 11, at(60), 1)) == [(1, 5, 120, 80, -40), (1, 6, 80, 90, 10), (2, 10, 50, 60, 10)]
    # key 1 is silent for 100 hours and forgotten, so its next price is a first one
    assert feed.add((3, 12, at(300), 2)) == []
    assert feed.add((1, 7, at(301), 500), (3, 13, at(400), 3)) == [(3, 12, 1, 2, 1)]
    assert feed.add((9, 99, at(900), 1)) == [(3, 13, 2, 3, 1)]


STATUS = "item long, n long, ts timestamp, status string"


def intervals(s):
    return R.off_market_intervals(s, "item", "n", F.col("status") == "off", "status", "5 hours", "50 hours")


def test_an_interval_is_closed_by_a_later_row_or_by_expiry(spark, tmp_path):
    us = lambda h: int(at(h).replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    feed = Feed(spark, tmp_path, STATUS, intervals)
    assert feed.add((1, 2, at(3), "on"), (1, 1, at(1), "off"), (2, 1, at(2), "off"), (2, 2, at(3), "off")) == []
    assert feed.add((3, 1, at(12), "on")) == [(1, us(1), us(3), "off")]
    assert feed.add((1, 3, at(13), "off")) == []
    assert feed.add((3, 2, at(70), "on")) == [(1, us(13), None, "off"), (2, us(2), None, "off")]
    assert feed.add((3, 3, at(300), "on"), (None, 1, at(300), "off"), (4, None, at(300), "off")) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_give_the_batch_twins(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(1, 6), i, at(rnd.randint(0, 40)), rnd.choice(["off", "on", "on"])) for i in range(120)]
    table = spark.createDataFrame(rows, STATUS)
    want = {(r.item, r.off_at, r.back_at) for r in H.off_market_intervals(table, "item", ["ts", "n"], F.col("status") == "off", "status", "ts").selectExpr("item", "unix_micros(off_at) off_at", "unix_micros(back_at) back_at").collect()}
    rnd.shuffle(rows)
    feed = Feed(spark, tmp_path, STATUS, lambda s: R.off_market_intervals(s, "item", "n", F.col("status") == "off", "status", "60 hours"))
    got = []
    for k in range(3):
        got += feed.add(*rows[k::3])
    got += feed.add((99, 999, at(10_000), "on"))
    assert {x[:3] for x in got} == want and len(got) == len(want)
