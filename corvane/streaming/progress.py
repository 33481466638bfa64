"""Progress of a stream as rows: a plan before it starts, one row for each micro-batch, and one when it is done.

Metrics are observed where they are computed (DataFrame.observe), reported by Spark with each micro-batch, and taken up by a
listener, so following a stream reads nothing twice.  The listener holds one row for each micro-batch and appends them to a
table in the shared folder as they come in, where another process can follow them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, type string, batch bigint, done bigint, total bigint, metrics map<string,double>"


class Progress(StreamingQueryListener):
    """Rows of one run: `write` is called with the new rows of each event."""

    def __init__(self, name: str, run: str, total: int | None, write: Callable[[list], None]):
        self.name, self.run, self.total, self.write = name, run, total, write
        self.done, self.sums, self.seen, self.query, self.ended = 0, {}, set(), None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query = event.id
            self.write([(self.run, "plan", None, 0, self.total, {})])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get(self.name) if p.name == self.name else None
        if found is None or p.batchId in self.seen:
            return
        self.seen.add(p.batchId)  # a batch that is reported again counts once
        values = {k: float(v) for k, v in found.asDict().items() if v is not None}
        if not values.get("rows"):
            return
        self.done += int(values["rows"])
        for k, v in values.items():
            self.sums[k] = self.sums.get(k, 0.0) + v
        self.write([(self.run, "progress", p.batchId, self.done, self.total, values)])

    def onQueryTerminated(self, event) -> None:
        if event.id == self.query:
            self.write([(self.run, "failed" if event.exception else "done", None, self.done, self.total, dict(self.sums))])
            self.ended.set()


def followed(df: DataFrame, name: str, metrics: dict[str, Column], table: str, start: Callable, total: int | None = None, wait: float = 60.0) -> DataFrame:
    """Runs a stream to its end and gives its progress (see SCHEMA), which is at `table` too.  `metrics`: sums over a
    micro-batch, beside its rows; `start(df, name)` starts the query and returns it; `total`: how many rows are planned."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    name = f"{name}-{run}"  # several runs of one stream can be followed at once
    lock = threading.Lock()

    def write(rows: list) -> None:
        with lock:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(table)

    listener = Progress(name, run, total, write)
    spark.streams.addListener(listener)
    try:
        observed = df.observe(name, F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(k) for k, c in metrics.items()))
        query = start(observed, name)
        query.awaitTermination()
        if not listener.ended.wait(wait):  # events come by their own thread
            raise TimeoutError("no report of the stream's end")
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(SCHEMA).parquet(table).where(F.col("run") == run)
