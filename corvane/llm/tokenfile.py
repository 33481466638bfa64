"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first.  Level 1 holds the first chunk of every id; each level has a bitmap
that says which of its chunks are continued, and the next level holds the chunks of just those, in order.  A rank
directory (set bits before every block of BLOCK_BITS) turns a position in one level into a position in the next by
counting within one block, so any token is read without decoding its neighbours.

A file is one shard of documents in ascending order of id: a header, the index (ids, first token of each document), and
the levels.  Shards are written as rows of a table in the shared folder by Spark's own committed writer, one complete
file in each row's `file` column, so lost executors and retried tasks leave no partial files; `export` puts them into
plain files.

Defined cases: null and empty texts are documents of the end token alone; null ids come first; repeated rows are
documents of their own, in order of their text's hash; a very long text makes a long shard of its own; an empty table
makes no shard; the id and the text alone are read, so other columns cannot clash."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, parts
from corvane.llm.tokens import ENCODE_BYTES, encoder

MAGIC = b"DACTOK01"
BLOCK_BITS = 512
#: A shard is closed at so many tokens; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 20
#: The starts of at most so many shards are broadcast.
BROADCAST_SHARDS = 200_000
_NULL_ID = -(1 << 63)


def encode(ids: np.ndarray) -> bytes:
    """The levels of a sequence of ids below 2**32."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(8)
        continued = more > 0
        bits = np.packbits(continued, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        per_block = np.unpackbits(bits).reshape(-1, BLOCK_BITS).sum(1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32)])
        last = not continued.any()
        out.append(struct.pack("<Q?", len(rest), last) + (rest & np.uint32(255)).astype(np.uint8).tobytes() + (b"" if last else bits.tobytes() + ranks.astype("<u4").tobytes()))
        if last:
            return b"".join(out)
        rest = more[continued]


def build(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A complete shard file."""
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
    keys = np.array([_NULL_ID if d is None else d for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<QQ", len(keys), int(starts[-1])) + keys.tobytes() + starts.tobytes() + encode(ids)


class TokenFile:
    """Random access to a shard file's tokens and documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens = struct.unpack_from("<QQ", data, 8)
        at = 24
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<i8", self.n_docs + 1, at)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        while True:
            n, last = struct.unpack_from("<Q?", data, at)
            at += 9
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            if last:
                self.levels.append((chunks, None, None))
                return
            blocks = -(-n // BLOCK_BITS)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        """The id at position i: one bit test and one rank in each level but the last."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                return out
            i = self._rank(bits, ranks, i)
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // BLOCK_BITS
        head = int.from_bytes(bits[block * BLOCK_BITS // 8 : (i >> 3) + 1].tobytes(), "little")
        return int(ranks[block]) + (head & ((1 << (i - block * BLOCK_BITS)) - 1)).bit_count()

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start up to end."""
        if start >= end:
            return np.zeros(0, np.uint32)
        out = np.zeros(end - start, np.uint32)
        where, a, b = np.arange(end - start), start, end
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            if bits is None:
                break
            own = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            if not own.any():
                break
            where = where[own]
            a = self._rank(bits, ranks, a)
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of shard files: part, shard (their order), n_docs, n_tokens, file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, number = encoder(tokenizer, spaces=False), TaskContext.get().partitionId(), 0
        keys, counts, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, counts, ids, held, number
            data = build(keys, np.array(counts, np.int64), np.concatenate(ids))
            row = [part, number, len(keys), held, data]
            keys, counts, ids, held, number = [], [], [], 0, number + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "shard", "n_docs", "n_tokens", "file"])

        for batch in batches:
            own = batch.column(batch.schema.get_field_index(key)).to_pylist()
            for i, j, texts in parts(batch, text, ENCODE_BYTES):
                flat, sizes = enc.encode(texts)
                at = 0
                for k, n in zip(own[i:j], sizes.tolist(), strict=True):
                    if held and held + n + 1 > shard_tokens:
                        yield close()
                    keys.append(k), counts.append(n + 1), ids.append(np.append(flat[at : at + n], np.uint32(end_id)))
                    at, held = at + n, held + n + 1
        if keys:
            yield close()

    # rows that repeat an id, and equal rows too, can lie in several ranges
    order = (F.col(key).asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc())
    numbered = docs.select(key, text, F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).select(key, text)
    return materialize(ordered.mapInArrow(run, "part int, shard bigint, n_docs bigint, n_tokens bigint, file binary"), "tokens")


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the shard files: doc_id, start, n_tokens, ids_crc32, and with `with_ids` the ids."""
    sizes = files.select("part", "shard", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = by_part.select("part", before.alias("part_start"))  # one row per part: totals alone meet in one task
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(by_part, "part").select("part", "shard", (F.col("inside") + F.col("part_start")).alias("first"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(data.as_buffer().to_pybytes())
                ids = f.tokens(0, f.n_tokens).astype("<u4")
                raw = [ids[a:b].tobytes() for a, b in zip(f.starts[:-1].tolist(), f.starts[1:].tolist())]
                keys = pa.array(f.doc_ids, mask=f.doc_ids == _NULL_ID)
                out = [keys, pa.array(f.starts[:-1] + first), pa.array(np.diff(f.starts)), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(raw, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    few = sizes.count() <= BROADCAST_SHARDS  # else the files are shuffled to their starts
    return files.join(F.broadcast(starts) if few else starts, ["part", "shard"]).select("first", "file").mapInArrow(run, schema)


def export(spark: SparkSession, files: DataFrame, folder: str) -> int:
    """Write each shard as a plain file part-shard.dac in a local folder, one at a time; the number of files."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in files.orderBy("part", "shard").toLocalIterator():
        with open(os.path.join(folder, f"{r['part']:06d}-{r['shard']:06d}.dac"), "wb") as out:
            out.write(r["file"])
        n += 1
    return n


def op6(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's digest, from the files read back."""
    return read(write(docs, tokenizer, end_id=1))
