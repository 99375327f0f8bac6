"""Streams with state per key: idempotent writes and admission, in event order whatever the order of arrival.

Keys are dealt into a fixed number of buckets by hash. Rows of a bucket wait in list state, packed, until the watermark has passed them; a timer
at the earliest of them wakes the bucket, which then handles what is due, key by key in order of (time, event), and sets the next timer. Rows later than the watermark allows are dropped
by Spark. The result of a stream thus does not depend on how its rows were cut into batches. State lives in RocksDB and its
checkpoint, so that a restart or a lost executor goes on where the last batch ended.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which these need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


#: Buckets of keys. State calls and timers are paid for once a bucket and batch, not once a key; a stream keeps its number for good.
BUCKETS = 256


def packed(pdf: pd.DataFrame) -> tuple[bytes]:
    """Rows as one value of a state."""
    table, sink = pa.Table.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


class InOrder(StatefulProcessor):
    """Hands the rows of each key of a bucket to step() in order once the watermark has passed them.

    names: what is kept of a row, `tw_t` (microseconds) first, then what breaks ties; out: the columns of the result after the key's.
    """

    def __init__(self, keys: list[str], names: list[str], out: list[str]):
        self.keys, self.names, self.out = keys, names, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "by_key binary")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, at: int) -> None:
        """A timer at the millisecond that ends after the time `at`, unless there is an earlier one."""
        due = at // 1000 + 1
        set_to = self.timer.get()
        if set_to is None or due < set_to[0]:
            if set_to is not None:
                self.handle.deleteTimer(set_to[0])
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            self.waiting.appendValue(packed(pdf[[*self.keys, *self.names]]))
            least = int(pdf["tw_t"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.wake(first)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = pickle.loads(self.held.get()[0]) if self.held.exists() else {}
        out, times = [], []
        if self.waiting.exists():
            rows = pa.concat_tables([pa.ipc.open_stream(x[0]).read_all() for x in self.waiting.get()], promote_options="permissive").to_pandas()
            due, later = rows[rows["tw_t"] < passed], rows[rows["tw_t"] >= passed]
            if len(later):
                self.waiting.put([packed(later)])
                times.append(int(later["tw_t"].min()))
            else:
                self.waiting.clear()
            by_key: dict[tuple, list[tuple]] = {}
            for of, row in zip(due[self.keys].itertuples(index=False, name=None), due[self.names].itertuples(index=False, name=None), strict=True):
                by_key.setdefault(of, []).append(row)
            for of, of_key in by_key.items():
                held[of], results = self.step(held.get(of), sorted(of_key))
                out += [(*of, *r) for r in results]
        # A key whose time is over may go, as later rows would find it over, too.
        ends = {of: self.ends(state) for of, state in held.items()}
        held = {of: state for of, state in held.items() if ends[of] is None or ends[of] >= passed}
        times += [ends[of] for of in held if ends[of] is not None]
        if held:
            self.held.update((pickle.dumps(held),))
        else:
            self.held.clear()
        if times:
            self.wake(min(times))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, *self.out])

    def step(self, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """What a key holds after rows in order, and their results."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int | None:
        """When what a key holds may go."""
        return None


class FirstWrites(InOrder):
    """The first fingerprint and resource of a key stand, for good or until the key has been idle for `retention` microseconds."""

    def __init__(self, keys: list[str], names: list[str], out: list[str], retention: int | None):
        super().__init__(keys, names, out)
        self.retention = retention

    def step(self, first: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        out = []
        for t, event, fingerprint, resource in rows:
            if first is not None and self.retention is not None and t > first[2] + self.retention:
                first = None
            if first is None:
                first, outcome = (fingerprint, resource, t), "created"
            else:
                first, outcome = (*first[:2], t), "replayed" if first[0] == fingerprint else "conflict"
            out.append((event, first[1], outcome))
        return first, out

    def ends(self, first: tuple) -> int | None:
        return first[2] + self.retention if self.retention is not None else None


class Admission(InOrder):
    """At most `limit` admitted events in any `span` microseconds; rejected ones do not count."""

    def __init__(self, keys: list[str], names: list[str], out: list[str], limit: int, span: int):
        super().__init__(keys, names, out)
        self.limit, self.span = limit, span

    def step(self, times: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        window, out = deque(times or ()), []
        for t, event in rows:
            while window and window[0] <= t - self.span:
                window.popleft()
            out.append((event, len(window) < self.limit))
            if out[-1][1]:
                window.append(t)
        return tuple(window), out

    def ends(self, times: tuple) -> int | None:
        return times[-1] + self.span if times else 0


class Arrivals(StatefulProcessor):
    """First writes in order of arrival; what a key holds goes `ttl` milliseconds after its last use."""

    def __init__(self, keys: list[str], out: list[str], ttl: int | None):
        self.keys, self.out, self.ttl = keys, out, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "fingerprint string, resource string", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = self.first.get() if self.first.exists() else None
        for pdf in rows:
            out = []
            for event, fingerprint, resource in zip(pdf["tw_event"], pdf["tw_fp"], pdf["tw_res"], strict=True):
                outcome = "created" if first is None else "replayed" if first[0] == fingerprint else "conflict"
                first = first or (fingerprint, resource)
                out.append((*key, event, first[1], outcome))
            yield pd.DataFrame(out, columns=[*self.keys, *self.out])
        self.first.update(first)


def prepared(stream: DataFrame, keys: list[str], at: str, lateness: str | None, **columns: Any) -> tuple[DataFrame, dict[str, str]]:
    """keys, tw_at (with a watermark), tw_t (microseconds) and columns of a stream; their types. Rows without a key or a time go.

    Names that start with an underscore do not reach a stateful processor.
    """
    time = F.col(at).cast("timestamp")
    rows = stream.select(*keys, time.alias("tw_at"), F.unix_micros(time).alias("tw_t"), *(c.alias(n) for n, c in columns.items())).dropna(subset=[*keys, "tw_at"])
    if lateness is not None:
        rows = rows.withWatermark("tw_at", lateness)
    return rows, {f.name: f.dataType.simpleString() for f in rows.schema.fields}


def first_writes(stream: DataFrame, keys: list[str], at: str, event: str, fingerprint: str, resource: str, lateness: str | None = "1 day", retention_seconds: float | None = None) -> DataFrame:
    """keys, event, resource, outcome of each request: created, replayed (the first resource comes back) or conflict.

    The first request by (at, event) counts, among those no later than `lateness`; None takes them in order of arrival. A key is
    forgotten when it has been idle for retention_seconds, by event time, or by the clock in order of arrival. Null fingerprints and resources
    count as empty texts; requests without a key or a time are left out. Start it within state_store().
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows, kinds = prepared(stream, keys, at, lateness, tw_event=F.col(event), tw_fp=text(fingerprint), tw_res=text(resource))
    out = [event, "resource", "outcome"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{event}` {kinds['tw_event']}, resource string, outcome string"])
    if lateness is None:
        ttl = None if retention_seconds is None else int(retention_seconds * 1000)
        return rows.groupBy(*keys).transformWithStateInPandas(Arrivals(keys, out, ttl), schema, "append", "none" if ttl is None else "processingTime")
    processor = FirstWrites(keys, ["tw_t", "tw_event", "tw_fp", "tw_res"], out, None if retention_seconds is None else int(retention_seconds * 1_000_000))
    return rows.withColumn("tw_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("tw_bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")


def admit_stream(stream: DataFrame, keys: list[str], at: str, event: str, limit: int, seconds: float = 60.0, lateness: str = "1 minute") -> DataFrame:
    """keys, event, admitted: at most `limit` admitted events of a key in any `seconds`, in order of (at, event).

    Events later than `lateness` and events without a key or a time are left out. A key's times go once they are `seconds` old. Start it
    within state_store().
    """
    rows, kinds = prepared(stream, keys, at, lateness, tw_event=F.col(event))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{event}` {kinds['tw_event']}, admitted boolean"])
    processor = Admission(keys, ["tw_t", "tw_event"], [event, "admitted"], limit, int(seconds * 1_000_000))
    return rows.withColumn("tw_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("tw_bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")


def append_to(stream: DataFrame, table: str, checkpoint: str, once: bool = False) -> None:
    """Run a stream of this module over all that is there and append its results to the Parquet table at `table`.

    A stream whose state goes by the clock never comes to an end by itself: it takes one batch, `once`.
    """
    with state_store(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        query = (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start(table)
    query.awaitTermination()
