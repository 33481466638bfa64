"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens.  Only the number of pieces of each length matters to packing, so
the plan is made on a table of at most `capacity` counts, however many documents there are: the longest length left
opens a bin, a bitset subset-sum program over the lengths left finds the fullest bin, and that combination is taken as
often as the counts allow.  The plan, a few thousand lines at most, then deals every piece its sequence and its place
by the piece's rank among those of its length.  Ranks come from counts over hashed chunks of each length, so no
length's pieces meet in one task.

Defined cases: null and empty texts are one piece that holds the end token; repeated rows are packed once each; texts
longer than the capacity are cut from the end, so that only the first piece may be shorter; pieces of one length are
dealt to chunks by row number and ranked by id, piece, crc32 and row number; an empty table
gives no pieces; the id and the text alone are read, so other columns cannot clash."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, parts, share
from corvane.llm.tokens import CACHED, ENCODE_BYTES, encoder

CAPACITY = 1024
#: Pieces of one length in a chunk, about.
CHUNK_ROWS = 500


def cut(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False, remembered: int = CACHED, at_once: int = ENCODE_BYTES) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and with `with_ids` the ids (little-endian unsigned
    32-bit integers).  `remembered` chunks and `at_once` bytes of text trade CPU seconds for a worker's memory."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True, remembered)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for i, _, texts in parts(batch, text, at_once):
                ids, counts = enc.encode(texts)
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                at = 0
                for k, n in enumerate(counts.tolist(), i):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4").tobytes()
                    at, n = at + n, n + 1
                    a, b, number = 0, n % capacity or capacity, 0
                    while a < n:
                        body = own[4 * a : 4 * b]
                        row.append(k), piece.append(number), start.append(a), length.append(b - a), crc.append(zlib.crc32(body))
                        if with_ids:
                            raw.append(body)
                        a, b, number = b, b + capacity, number + 1
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(raw, pa.binary())] if with_ids else [])],
                    names=[key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                )

    return docs.select(key, text).mapInArrow(run, schema)


def fullest(counts: np.ndarray, room: int) -> dict:
    """The combination of lengths (counts[l] of length l at most) with the largest sum within `room`, by dynamic
    programming over bitsets: bit s of `reach` says that the sum s can be made.  Longer lengths are preferred."""
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, times = min(int(counts[length]), room // length), 1
        while left > 0 and not reach >> room & 1:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, times = left - times, times * 2
    total, out = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + times
            total -= length * times
    return out


def plan(histogram: dict, capacity: int = CAPACITY) -> list:
    """[(first sequence, sequences, {length: pieces in each})] by minimum bin slack."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out, at = [], 0
    while counts.any():
        seed = int(np.flatnonzero(counts)[-1])
        counts[seed] -= 1
        bin_ = fullest(counts, capacity - seed)
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(int(counts[length]) // k for length, k in bin_.items())
        for length, k in bin_.items():
            counts[length] -= times * k
        out.append((at, times, bin_))
        at += times
    return out


def slots(plan_: list) -> dict:
    """The plan as arrays sorted by length and rank: pieces of a length, ranked from 0, fill the slots in turn."""
    rows, filled = [], {}
    for first, times, bin_ in plan_:
        offset = 0
        for length, k in sorted(bin_.items(), reverse=True):
            rank = filled.get(length, 0)
            rows.append((length, rank, k, first, offset))
            filled[length] = rank + times * k
            offset += length * k
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "rank", "each", "first", "offset"))}


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces (a table that can be read again: key, piece, start, length, ...) with sequence_id and offset.  A column _row
    of row numbers, which goes, deals equal rows to chunks too."""
    numbered = "_row" in pieces.columns
    spark = pieces.sparkSession
    per_length = pieces.groupBy("length").count()
    histogram = {r["length"]: r["count"] for r in per_length.collect()}  # at most `capacity` rows
    table = share(spark, slots(plan(histogram, capacity)))

    chunked = spark.createDataFrame([(n, max(1, -(-c // CHUNK_ROWS))) for n, c in histogram.items()] or [(0, 1)], "length bigint, chunks bigint")
    dealt = pieces.join(F.broadcast(chunked), "length").withColumn("chunk", F.pmod(F.xxhash64("_row") if numbered else F.xxhash64(key, "piece", "ids_crc32"), "chunks")).drop("chunks")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("length", "chunk").count().select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "chunk").orderBy(key, "piece", "ids_crc32", *(["_row"] if numbered else [])))
    ranked = dealt.withColumn("rank", own.cast("bigint") - 1).join(offsets, ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    kept = [c for c in pieces.columns if c != "_row"]
    ranked = ranked.select(*kept, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in kept) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table()
        wide = np.int64(1) << np.int64(48)
        keys = t["length"] * wide + t["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            rest = rank - t["rank"][at]
            sequence, offset = t["first"][at] + rest // t["each"][at], t["offset"][at] + rest % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def op2(docs: DataFrame, tokenizer: str, remembered: int = CACHED, at_once: int = ENCODE_BYTES) -> DataFrame:
    """The contract's digest."""
    pieces = materialize(cut(docs, tokenizer, end_id=2, remembered=remembered, at_once=at_once).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces)
