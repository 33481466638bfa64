"""Claim queues, segments that time out and distinct counts as state of many small entries, with timers, in RocksDB."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a key that are held at once, and that are read or given back at once.
RUN, SLICE = 200_000, 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, which these processors need, for queries of this session that start from now on."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ordered(batches: Iterator[pd.DataFrame], by: list[str], run: int | None = None) -> Iterator[tuple]:
    """The rows of one key in a micro-batch, in order of some columns, missing values last.  Up to RUN rows are sorted in
    memory; more become sorted runs in temporary files of this call (a task's own spill, gone with it), which are merged."""
    places, files, held, size, run = None, [], [], 0, run or RUN

    def key(r: tuple) -> tuple:
        return tuple((r[i] is None or r[i] != r[i], 0 if r[i] is None or r[i] != r[i] else r[i]) for i in places)

    def spilled(f) -> Iterator[tuple]:
        f.seek(0)
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return

    try:
        for b in batches:
            places = [b.columns.get_loc(c) for c in by]
            held += b.itertuples(index=False, name=None)
            if len(held) >= run:
                files.append(tempfile.TemporaryFile())
                rows = iter(sorted(held, key=key))
                while part := list(islice(rows, SLICE)):
                    pickle.dump(part, files[-1])
                held = []
        held.sort(key=key)
        yield from heapq.merge(*map(spilled, files), held, key=key) if files else held
    finally:
        for f in files:
            f.close()


class _Claims(StatefulProcessor):
    """Of each item its place in the queue (-1 before it is added) and whether it is done, items by place while they are
    not, the outstanding claims, and how far the queue has been handed out.  A request looks at the outstanding claims, of
    which a worker has few, and at the head of the queue.

    State is asked and told over a socket, so what a micro-batch has touched is held and told once, at its end or when
    there are RUN of it; what the state cannot have is not asked for."""

    def __init__(self, manifest: str, ttl: int):
        self.manifest, self.ttl = manifest, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "item string", "place bigint, done boolean")
        self.items = handle.getMapState("items", "place bigint", "item string")
        self.claims = handle.getMapState("claims", "place bigint", "worker string, at bigint")
        self.ends = handle.getValueState("ends", "head bigint, size bigint")

    def handleInputRows(self, key, rows, timerValues):
        head, size = self.ends.get() if self.ends.exists() else (0, 0)
        before = {p[0]: (w, at) for p, (w, at) in self.claims.iterator()} if self.claims.exists() else {}
        told = self.known.exists()  # whether state has items that are not held
        claims, out, held, waiting, stored = dict(before), [], {}, {}, set()

        def look(item: str) -> list:
            """[place, done, changed] of an item, place -1 if it has none."""
            if item not in held:
                found = told and self.known.containsKey((item,))
                held[item] = [*self.known.getValue((item,)), False] if found else [-1, False, False]
            return held[item]

        def at(place: int) -> str:
            if place not in waiting:
                waiting[place] = self.items.getValue((place,))[0]
                stored.add(place)
            return waiting[place]

        def tell() -> None:
            for item, (place, done, changed) in held.items():
                if changed:
                    self.known.updateValue((item,), (place, done))
            for place, item in waiting.items():
                if (place >= head or place in claims) and place not in stored:
                    self.items.updateValue((place,), (item,))
            held.clear(), waiting.clear(), stored.clear()

        for now, seq, worker, action, item in ordered(rows, ["at", "seq"]):
            if action == "add" and item is not None:
                if (x := look(item))[0] < 0:
                    x[0], x[2], waiting[size] = size, True, item
                    size += 1
            elif action == "save" and item is not None:
                x = look(item)
                x[1] = x[2] = True
                claims.pop(x[0], None)
            elif action == "next":
                while head < size and look(at(head))[1]:
                    head += 1
                able = [p for p, (w, t) in claims.items() if w == worker or now - t >= self.ttl]
                pick = min(able, default=head)
                pick = min(pick, head) if head < size else (pick if able else None)
                if pick is not None:
                    claims[pick] = (worker, now)
                    head += pick == head
                out.append((key[0], seq, worker, None if pick is None else at(pick)))
                if len(out) == SLICE:
                    yield pd.DataFrame(out, columns=[self.manifest, "seq", "worker", "item"])
                    out = []
            if len(held) + len(waiting) >= RUN:
                tell()
                told = True
        tell()
        for p in before.keys() - claims.keys():
            self.claims.removeKey((p,))
        for p, c in claims.items():
            if before.get(p) != c:
                self.claims.updateValue((p,), c)
        self.ends.update((head, size))
        yield pd.DataFrame(out, columns=[self.manifest, "seq", "worker", "item"])

    def close(self) -> None:
        pass


def claims(requests: DataFrame, manifest: str, ttl_seconds: int = 900) -> DataFrame:
    """A claim queue.  requests: (manifest, ts, seq, worker, action, item), actions `add` (puts an item in), `next` and
    `save`; others, and adds and saves of null, do nothing.  `next` hands out the first item, in order of adding, that is not
    saved and not held by another worker within the time to live: a worker's own claim is offered again, and its time
    begins anew.  `save` takes an item out for good, before its adding too.  Requests of a micro-batch are taken in order of
    time and seq.  The queue of a manifest is one key by nature, since hand-out is exclusive."""
    rocksdb(requests.sparkSession)
    kind = requests.schema[manifest].dataType.simpleString()
    rows = requests.select(manifest, F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("bigint").alias("seq"), F.coalesce("worker", F.lit("")).alias("worker"), "action", "item")
    bare = _Bare(_Claims(manifest, ttl_seconds), ["at", "seq", "worker", "action", "item"])
    return rows.groupBy(manifest).transformWithStateInPandas(bare, f"`{manifest}` {kind}, seq bigint, worker string, item string", "append", "None")


class _Bare(StatefulProcessor):
    """Gives a processor the named columns of its rows, in that order."""

    def __init__(self, inner: StatefulProcessor, columns: list[str]):
        self.inner, self.columns = inner, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        yield from self.inner.handleInputRows(key, (b[self.columns].astype(object).where(b[self.columns].notna(), None) for b in rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self.inner.close()


class _Quota(StatefulProcessor):
    """How many events each day of a key has had; a timer at the day's end drops the entry."""

    def __init__(self, columns: list[str], limit: int):
        self.columns, self.limit = columns, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        counts, out = {}, []
        for _, event, day in ordered(rows, ["at", "event"]):
            if day not in counts:
                counts[day] = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
            counts[day] = n = counts[day] + 1
            out.append((key[0], day, event, n, n <= self.limit, max(self.limit - n, 0)))
            if len(out) == SLICE:
                yield self._frame(out)
                out = []
        for day, n in counts.items():
            self.days.updateValue((day,), (n,))
            if (end := (day + 1) * 86_400_000) > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(end)
        yield self._frame(out)

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.columns).astype({self.columns[2]: "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        day = expiredTimerInfo.getExpiryTimeInMs() // 86_400_000 - 1
        if self.days.containsKey((day,)):
            self.days.removeKey((day,))
        yield self._frame([])

    def close(self) -> None:
        pass


def quota(events: DataFrame, key: str, ts: str, order: str, limit: int, delay: str = "1 day") -> DataFrame:
    """Accept or deny each event: the n-th of a key and day is allowed up to the limit.  All events of a key in one
    micro-batch are numbered in order of time and `order` (null last).  A day's counter is dropped when the watermark passes
    its end; events later than that are dropped by the watermark."""
    rocksdb(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = timed.select(key, "_ts", F.unix_micros("_ts").alias("at"), F.col(order).cast("bigint").alias("event"), F.unix_date(F.to_date("_ts")).alias("day"))
    bare = _Bare(_Quota([key, "day", "event", "nth", "allowed", "remaining"], limit), ["at", "event", "day"])
    out = rows.groupBy(key).transformWithStateInPandas(bare, f"`{key}` {kind}, day int, event bigint, nth bigint, allowed boolean, remaining bigint", "append", "EventTime")
    return out.withColumn("day", F.date_from_unix_date("day"))


class _Segments(StatefulProcessor):
    """The open segment of a session: seconds held, its first and last chunk, its number, and when the last chunk came."""

    def __init__(self, session: str, most: float, idle_ms: int):
        self.columns, self.most, self.idle = [session, "segment", "first", "last", "seconds", "flushed"], most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "held double, first bigint, last bigint, number bigint, at bigint")

    def handleInputRows(self, key, rows, timerValues):
        held, first, last, number, at = self.open.get() if self.open.exists() else (0.0, None, None, 0, 0)
        out = []
        for now, seq, seconds in ordered(rows, ["at", "seq"]):
            if first is not None and now - at >= self.idle:
                out.append((key[0], number, first, last, held, "idle"))
                held, first, number = 0.0, None, number + 1
            first, last, at = seq if first is None else first, seq, max(at, now)
            held += seconds or 0.0
            if held >= self.most:
                out.append((key[0], number, first, last, held, "full"))
                held, first, number = 0.0, None, number + 1
        self.open.update((held, first, last, number, at))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if first is not None:
            self.handle.registerTimer(at + self.idle)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, first, last, number, at = self.open.get()
        out = []
        if first is not None:
            out.append((key[0], number, first, last, held, "idle"))
            self.open.update((0.0, None, None, number + 1, at))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def bounded_segments(chunks: DataFrame, session: str, ts: str, order: str, seconds: str, most: float = 10.0, idle: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """(session, segment, first, last, seconds, flushed): segments flushed whenever a session's buffered seconds reach a bound
    (`full`), and what is left once nothing has come for `idle` (`idle`): at the next chunk, or by a timer without one, when the
    watermark passes that time.  Chunks are taken in order of time and `order`; null seconds count as 0, chunks without a
    time are dropped by the watermark."""
    spark = chunks.sparkSession
    rocksdb(spark)
    kind = chunks.schema[session].dataType.simpleString()
    idle_ms = spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + interval {idle})")).first()[0]
    timed = chunks.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = timed.select(session, "_ts", F.unix_millis("_ts").alias("at"), F.col(order).cast("bigint").alias("seq"), F.col(seconds).cast("double").alias("seconds"))
    bare = _Bare(_Segments(session, most, idle_ms), ["at", "seq", "seconds"])
    return rows.groupBy(session).transformWithStateInPandas(bare, f"`{session}` {kind}, segment bigint, first bigint, last bigint, seconds double, flushed string", "append", "EventTime")


class _Distinct(StatefulProcessor):
    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        n = new = 0
        for b in rows:
            n += len(b)
            for k in b["counted"].dropna().unique():
                if not self.seen.containsKey((k,)):
                    self.seen.updateValue((k,), (1,))
                    new += 1
        yield pd.DataFrame({self.kind: [key[0]], "n": [n], "keys": [new]})

    def close(self) -> None:
        pass


def session_counts(events: DataFrame, kind: str, key: str, buckets: int = 64) -> DataFrame:
    """(kind, n, keys): events and keys not seen before, for each micro-batch, kind and bucket of keys, to be summed by kind.
    Each key is an entry of state of its own, and a kind's keys are dealt to buckets, so that neither is held whole."""
    rocksdb(events.sparkSession)
    dealt = events.select(kind, F.col(key).cast("string").alias("counted"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("bucket"))
    schema = f"`{kind}` {events.schema[kind].dataType.simpleString()}, n bigint, keys bigint"
    return dealt.groupBy(kind, "bucket").transformWithStateInPandas(_Distinct(kind), schema, "append", "None")
