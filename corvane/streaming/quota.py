"""Sessions, statistics and partial commits over streams, and how a stream is run into a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.sources.sinks import shared_folder
from corvane.streaming.stateful import SLICE, ordered


def consented(events: DataFrame, consent: str, kind: str = "kind", kinds: tuple = ("segment", "final")) -> DataFrame:
    """Session events that may be stored: of a known kind, and only with the speaker's consent (null is none)."""
    return events.where(F.coalesce(F.col(consent), F.lit(False)) & F.col(kind).isin(*kinds))


def session_windows(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of each session, closed by a gap."""
    w = F.session_window(ts, gap)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, name: str, delay: str = "1 hour", base: str | None = None) -> DataFrame:
    """All sessions of what is available.  The stream gives a session, and drops its state, when the watermark closes it; so
    its table has the closed ones, and its state the others."""
    windows = session_windows(events, key, ts, gap, delay)
    base = base or f"{shared_folder(events.sparkSession)}/{name}-{uuid.uuid4().hex}"
    closed = run_to_table(windows, name, base=base)
    state = events.sparkSession.read.format("statestore").load(f"{base}/checkpoint")
    still = state.select(F.col("value")[key].alias(key), F.col("value.session_window.start").alias("start"), F.col("value.session_window.end").alias("end"), F.col("value.count").alias("n"))
    return closed.unionByName(still)


def session_statistics(events: DataFrame, kind: str, key: str) -> DataFrame:
    """Events and about how many keys of each kind, from a sketch of fixed size, for complete mode.  Exact counts of keys:
    stateful.session_counts."""
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.approx_count_distinct(key).alias("keys"))


def partial_commit(partials: DataFrame, session: str, order: str, text: str, volatile: int = 3) -> DataFrame:
    """For each partial hypothesis the words locked so far: all but the last few lock, and locked words never change."""
    kind = partials.schema[session].dataType.simpleString()
    rows = partials.select(session, F.col(order).cast("bigint").alias("seq"), F.col(text).alias("text"))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        locked, out = list(state.get[0]) if state.exists else [], []
        for seq, text in ordered((b[["seq", "text"]] for b in batches), ["seq"]):
            words = (text or "").split()
            locked += words[len(locked) : max(len(locked), len(words) - volatile)]
            out.append((k[0], int(seq), list(locked)))
            if len(out) == SLICE:
                yield pd.DataFrame(out, columns=[session, "seq", "locked"])
                out = []
        state.update((locked,))
        yield pd.DataFrame(out, columns=[session, "seq", "locked"])

    return rows.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, seq bigint, locked array<string>", "locked array<string>", "append", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Drive a stream through all that is available, and the rows it gave.  In append mode they are written as Parquet by
    the committed file sink, with the query's checkpoint beside them, both in the shared folder; a complete result is as
    small as its groups and is rewritten there by each batch.  With the same `base` a later run goes on where the last one
    ended, and gives the rows of all."""
    base = base or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{base}/rows").start()
    else:
        q = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/rows")).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/rows")
