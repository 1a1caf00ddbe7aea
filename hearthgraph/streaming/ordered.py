"""Streams whose result depends on the order of a key's rows, whatever order they arrive in.

Keys share a state by their hash, BUCKETS in all, since each call from Python into the state costs
more than a key's rows do. A bucket keeps the rows that wait and, for each key, what has come of those
before. A timer wakes it when the watermark passes its first waiting row: rows that the watermark has
passed are sorted and taken, key by key, the others wait on, as a row that belongs before them may
still come. So rows shuffled within the watermark's delay give what the sorted table gives. A key that
is silent for a delay of its own is closed and its state goes. What waits is what came within the delay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that lists and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: States that keys share: a table of 200 million rows that all wait has 200,000 in each.
BUCKETS = 1024

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}

#: take(before, row) -> (after, output row or None); close(before) -> output row or None. `before` is
#: None for a key's first row, else the tuple given as `after`; a row is (at, id, *fields), at in
#: microseconds; fields must have a JSON form.
Take = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]
Close = Callable[[tuple], tuple | None]


class InOrder(StatefulProcessor):
    """types: Arrow types of the key, at, id and the fields, in that order."""

    def __init__(self, take: Take, close: Close | None, types: dict[str, pa.DataType], names: list[str], forget_ms: int):
        self.take, self.close_key, self.forget_ms, self.names, self.types = take, close, forget_ms, names, types

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # an Arrow table for each batch
        self.last = handle.getValueState("last", "rows string")  # a JSON list of [key, at, state]

    def table(self, rows: pd.DataFrame) -> pa.Table:
        columns = {}
        for c, kind in self.types.items():
            missing = rows[f"no_{c}"].to_numpy(dtype=bool) if f"no_{c}" in rows else None
            columns[c] = pa.array(rows[c], type=kind, from_pandas=True) if missing is None else pa.array(rows[c].to_numpy(), type=kind, mask=missing)
        return pa.table(columns)

    def types_only(self) -> pa.Table:
        return pa.schema(list(self.types.items())).empty_table()

    def wait(self, rows: pa.Table) -> None:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(rows)
        self.waiting.appendValue((out.getvalue().to_pybytes(),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = pa.concat_tables([self.types_only(), *(self.table(r[~r["no_id"].astype(bool)]) for r in rows)])
        if passed > 0:
            new = new.filter(pc.greater(new["at"], passed))  # the others are too late
        if new.num_rows:
            self.wait(new)
            self.handle.registerTimer(pc.min(new["at"]).as_py() // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [pa.ipc.open_stream(bytes(blob)).read_all() for (blob,) in self.waiting.get()]
        last = self.last.get()
        states: dict[Any, tuple[int, tuple]] = {k: (at, tuple(s)) for k, at, s in json.loads(last[0])} if last else {}
        found: list[tuple] = []
        held: set = set()
        wake: list[int] = []
        if parts:
            rows = pa.concat_tables(parts)
            gone = pc.less_equal(rows["at"], now)
            due, later = rows.filter(gone).sort_by([(c, "ascending") for c in ("key", "at", "id")]), rows.filter(pc.invert(gone))
            for k, mine in groupby(zip(*(c.to_pylist() for c in due.columns)), lambda r: r[0]):
                at, state = states.get(k, (None, None))
                for r in mine:
                    at = r[1]
                    state, out = self.take(state, r[1:])
                    if out is not None:
                        found.append((k, *out))
                states[k] = at, state
            if due.num_rows:
                self.waiting.clear()
                if later.num_rows:
                    self.wait(later)
            if later.num_rows:
                held = set(later["key"].to_pylist())
                wake.append(pc.min(later["at"]).as_py() // 1000 + 1)
        for k, (at, state) in list(states.items()):
            ends = at // 1000 + self.forget_ms
            if k in held:
                continue
            if ends * 1000 <= now:
                out = self.close_key(state) if self.close_key else None
                if out is not None:
                    found.append((k, *out))
                del states[k]
            else:
                wake.append(ends + 1)
        if states:
            self.last.update((json.dumps([(k, at, s) for k, (at, s) in states.items()]),))
        elif last:
            self.last.clear()
        if wake:
            self.handle.registerTimer(min(wake))
        if found:
            yield pd.DataFrame({n: pd.Series(c, dtype="object") for n, c in zip(self.names, zip(*found))})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, ts: str, row_id: str, fields: dict[str, str], out: str, take: Take, close: Close | None, delay: str, forget: str | None = None) -> DataFrame:
    """rows by key in the order of (ts, row_id), within the watermark's delay. fields: columns and
    their types that take() gets; out: columns of the result after the key. Rows without time or id
    only move the watermark."""
    spark: SparkSession = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = rows.schema[key].dataType.simpleString()
    ms = int(pd.Timedelta(forget or delay) / pd.Timedelta("1ms"))
    # plain names: those with a line before them do not reach the frames
    given = {"key": (F.col(key), kind), "at": (F.unix_micros(F.col(ts).cast("timestamp")), "bigint"), "id": (F.col(row_id), "bigint")} | {f"field{i}": (F.col(c), t) for i, (c, t) in enumerate(fields.items())}
    columns = [F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")]
    for c, (x, t) in given.items():  # pandas would turn numbers to floats where some are missing
        x = x.cast(t)
        columns += [x.alias(c)] if t == "string" else [F.coalesce(x, F.lit(0).cast(t)).alias(c), x.isNull().alias(f"no_{c}")]
    slim = rows.withWatermark(ts, delay).where(F.col(ts).isNotNull()).select(columns)
    made = InOrder(take, close, {c: _ARROW[t] for c, (_, t) in given.items()}, [key, *(x.split()[0] for x in out.split(", "))], ms)
    return slim.groupBy("bucket").transformWithStateInPandas(made, f"{key} {kind}, {out}", "append", "EventTime")
