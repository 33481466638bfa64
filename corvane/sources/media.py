"""Media probes without codecs: RIFF/WAVE containers, by walking their chunks over ranges of the files' bytes.

A first range of HEAD bytes of each file goes to the walker.  Where a chunk leads beyond it (a long list of tags before the
samples), the next range starts at that chunk, for those files alone, until none is left; the samples themselves are never
sent to Python."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.sinks import kept

HEAD = 4096
#: Files whose next chunk is still to be read are broadcast, by path and place, if there are at most so many.
BROADCAST_OPEN = 100_000
# Format tags of the container, and names of sample codecs by tag and bits.
PCM, FLOAT, ALAW, MULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
CODECS = {(PCM, 8): "pcm_u8", (PCM, 16): "pcm_s16le", (PCM, 24): "pcm_s24le", (PCM, 32): "pcm_s32le", (FLOAT, 32): "pcm_f32le", (FLOAT, 64): "pcm_f64le", (ALAW, 8): "pcm_alaw", (MULAW, 8): "pcm_mulaw"}
STATE = "at bigint, tag int, channels int, rate bigint, bytes_a_second bigint, bits int, samples bigint, done boolean"


def walk(head: bytes, length: int, at: int, known: dict) -> dict:
    """The chunks of a container from place `at` of the file, of which `head` holds the bytes from there on.  Returns what is
    known by then; `done` unless the next chunk's header lies beyond `head`."""
    state, place = dict(known), 0
    if at == 0:
        if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
            return state | {"at": 0, "done": True}
        place = 12
    while True:
        if at + place + 8 > length:
            return state | {"at": at + place, "done": True}
        if place + 8 > len(head) or (head[place : place + 4] == b"fmt " and place + 8 + 26 > len(head) and at + len(head) < length and place):
            return state | {"at": at + place, "done": False}
        name, size = head[place : place + 4], struct.unpack_from("<I", head, place + 4)[0]
        if name == b"fmt " and size >= 16 and place + 24 <= len(head):
            tag, channels, rate, per_second, _, bits = struct.unpack_from("<HHIIHH", head, place + 8)
            if tag == EXTENSIBLE and size >= 40 and place + 34 <= len(head):
                tag = struct.unpack_from("<H", head, place + 32)[0]
            state |= {"tag": tag, "channels": channels, "rate": rate, "bytes_a_second": per_second, "bits": bits}
        elif name == b"data":
            # a stream's length is unknown (all ones) and a broken file's is too long: what is there counts
            return state | {"samples": min(size, length - at - place - 8), "at": at + place, "done": True}
        place += 8 + size + size % 2  # chunks begin at even places


def probed(files: DataFrame, path: str = "path", content: str = "content", head: int = HEAD) -> DataFrame:
    """(path, duration, codec, sr, ch, ok) of each file, by its path, which must be its own: duration 0.0 and nulls where it is no container with samples, and
    for null contents.  A file that ends early has the duration of what is there."""
    fields = [f.split()[0] for f in STATE.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[f.split()[1]] for f in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for piece, length, *held in zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns))):
                known = dict(zip(fields, held, strict=True))
                out.append(walk(piece, length, known["at"], known) if piece is not None else known | {"done": True})
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[f] for o in out], k) for f, k in zip(fields, kinds, strict=True))], names=["path", *fields])

    rows = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    length = F.octet_length("content").cast("bigint").alias("length")
    start = [F.lit(0).cast("bigint").alias("at"), *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in STATE.split(", ")[1:-1]), F.lit(False).alias("done")]
    ranges, found = rows.select("path", F.expr(f"substring(content, 1, {head})").alias("piece"), length, *start), None
    while True:
        state = kept(ranges.mapInArrow(run, f"path string, {STATE}"), "probed")
        closed, open_ = state.where("done"), state.where("not done")
        found = closed if found is None else found.unionByName(closed)
        n = open_.count()
        if not n:
            break
        # only open files meet their next place; few of them are broadcast, so that no content is shuffled
        met = rows.join(F.broadcast(open_) if n <= BROADCAST_OPEN else open_, "path")
        ranges = met.select("path", F.expr(f"substring(content, cast(at + 1 as int), {head})").alias("piece"), length, *fields)
    codec = F.lit(None).cast("string")
    for (tag, bits), name in CODECS.items():
        codec = F.when((F.col("tag") == tag) & (F.col("bits") == bits), name).otherwise(codec)
    ok = F.coalesce((F.col("bytes_a_second") > 0) & F.col("samples").isNotNull(), F.lit(False))
    out = found.withColumn("ok", ok)
    return out.select("path", F.when(ok, F.col("samples") / F.col("bytes_a_second")).otherwise(0.0).alias("duration"), F.when(ok, codec).alias("codec"), F.when(ok, F.col("rate").cast("string")).alias("sr"), F.when(ok, F.col("channels").cast("string")).alias("ch"), "ok")


def wave_bytes(samples, rate: int, channels: int = 1, before: bytes = b"") -> bytes:
    """A container of 16-bit samples; `before`: chunks to put ahead of them."""
    data = b"".join(struct.pack("<h", max(-32768, min(32767, int(x)))) for x in samples)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, PCM, channels, rate, 2 * rate * channels, 2 * channels, 16)
    body = b"WAVE" + fmt + before + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body
