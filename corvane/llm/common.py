"""Helpers shared by the training-data operators: shared scratch tables, text
batches, word caches and hashing."""

from __future__ import annotations

import atexit
import pickle
import sys
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but these six ASCII characters; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts of more characters are not used to fit a model, so a sample's bytes are bounded as its rows are.
LONGEST_SAMPLED = 200_000

#: Rows of an Arrow batch, at most: whole texts and sets are in it, in the executor and in its Python worker.
BATCH_ROWS = 1000

#: Bytes of text that a kernel handles at once; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- scratch tables


_folders: set = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset a local master (tests, a single machine) gets
    one of our own, and a cluster an error, since its executors share no temporary folder."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows alone, for a session: the kernels here need no more than BATCH_ROWS at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def materialize(df: DataFrame, tag: str = "step", rows: int | None = None, per_file: int = 25_000) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut and survives lost executors.  With
    `rows`, about how many there are at most, the table gets no more files than one for each `per_file` rows: a shuffle's
    many small partitions make few files."""
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/corvane/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_clear, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    small_batches(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._corvane_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing will read again."""
    _delete(df.sparkSession.sparkContext, df._corvane_path)


def _delete(sc: SparkContext, folder: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _clear(folder: str) -> None:
    """At the end of the driver's process: an application's scratch tables go with it."""
    if (sc := SparkContext._active_spark_context) is not None:
        _delete(sc, folder)


def share(spark: SparkSession, value) -> Callable:
    """Send a bounded object to the executors once; the result, called in a task, gives it back there."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


# --------------------------------------------------------------------------- splits


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def stable_hash(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def sample_per_class(df: DataFrame, label: str, key: str, columns: list[str], per_class: int) -> tuple[list, dict]:
    """At most `per_class` rows of each label value, the smallest by hash of the key and the columns: a bounded,
    repeatable sample on the driver for fitting a classifier.  Rows are chosen by a share of the hashes that gives a
    little more than that many, and repeated rows count once.  Also the number of rows of each label value."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}
    if not counts:
        return [], {}
    pairs = []
    for value, n in counts.items():
        pairs += [F.lit(value), F.lit(min(1.0, 1.3 * per_class / n + 20.0 / n))]
    share = F.create_map(*pairs)[F.col(label)]
    # a null or repeated id is told apart by the other columns
    own = F.xxhash64(F.col(key), *(F.col(c) for c in columns if c != key), F.lit(71))
    unit = own.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    chosen = df.where(F.col(label).isNotNull()).where(unit <= share).select(unit.alias("_unit"), label, *columns).distinct()
    rows = chosen.collect()
    rows.sort(key=lambda r: (r[0], str(r[1]), *(str(x) for x in r[2:])))
    taken: dict = {}
    out = []
    for r in rows:
        if taken.get(r[1], 0) < per_class:
            taken[r[1]] = taken.get(r[1], 0) + 1
            out.append(r)
    return out, counts


# --------------------------------------------------------------------------- text batches


#: Name under which a Python worker holds memory that outlives a task (see tokens.encoder).
HELD = "_corvane_encoders"


def forget() -> None:
    """Called by kernels without an encoder: a reused worker gives up what an earlier operator's tasks left in it."""
    sys.modules.pop(HELD, None)


def parts(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, list]]:
    """(i, j, texts of rows i up to j as UTF-8 bytes, None for null): ranges whose texts together hold about `budget`
    bytes; a longer text makes a range of its own.  Only one range is copied out of the batch at a time."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).tolist()
    start = held = 0
    for i, n in enumerate([*sizes, budget + 1]):
        if i > start and held + n > budget:
            yield start, i, col.slice(start, i - start).cast(pa.binary()).to_pylist()
            start, held = i, 0
        held += n


def append_columns(
    df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]]
) -> DataFrame:
    """df with columns computed from its text column.  `make` runs once for each task and returns a kernel from a list
    of UTF-8 texts (None: null) to one array for each field.  Input columns named like a field give way to it, which each
operator that uses this says of its own."""
    small_batches(df.sparkSession)
    names = {f.name for f in fields}
    keep = [c for c in df.columns if c not in names or c == text]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in keep), *fields])
    kinds = [_arrow_type(f.dataType) for f in fields]
    out_names = [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kernel = make()
        for batch in batches:
            for i, j, texts in parts(batch, text):
                part = batch.slice(i, j - i)
                made = [pa.array(v, type=k) for v, k in zip(kernel(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *made], names=out_names)

    return df.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def split_words(texts: list) -> tuple[list, np.ndarray]:
    """All words of all texts, and how many each text has."""
    words: list = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.split()
            counts[i] = len(w)
            words += w
    return words, counts


class WordCache:
    """Numbers distinct words; `grow(words, start)` is called with the new ones, in order.  At `limit` words those seen
    once are dropped by `compact(numbers kept)`, or all if there is no such function, so that memory is bounded; results
    do not depend on it."""

    def __init__(self, grow: Callable[[list, int], None], limit: int = 250_000, compact: Callable[[np.ndarray], None] | None = None):
        self.grow, self.limit, self.compact, self.ids = grow, limit, compact, {}
        self.seen = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.seen[: len(self.ids)] > 1) if self.compact else []
        if not self.compact or len(kept) > self.limit // 2:
            self.ids.clear()
            self.seen[:] = 0
            return
        words = list(self.ids)
        self.ids = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.seen = self.seen[kept]
        self.compact(kept)

    def lookup_array(self, words: pa.Array) -> np.ndarray:
        """The numbers of an Arrow array of words; only its distinct words become objects."""
        coded = words.dictionary_encode()
        return self._numbers(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False))

    def lookup(self, words: list) -> np.ndarray:
        # a small dict numbers this call's distinct words first, so the large one is asked once for each of them
        local = defaultdict(count().__next__)
        at = np.fromiter(map(local.__getitem__, words), np.int64, len(words))
        return self._numbers(list(local), at)

    def _numbers(self, distinct: list, at: np.ndarray) -> np.ndarray:
        if len(self.ids) > self.limit:
            self._shrink()
        got = np.fromiter(map(self.ids.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(got < 0)):
            new = list(map(distinct.__getitem__, missing.tolist()))
            start = len(self.ids)
            self.grow(new, start)
            got[missing] = np.arange(start, start + len(new))
            self.ids.update(zip(new, range(start, start + len(new))))
        if self.compact and len(got):
            if len(self.ids) > len(self.seen):
                self.seen = np.concatenate([self.seen, np.zeros(max(len(self.ids), 2 * len(self.seen)) - len(self.seen), np.int64)])
            self.seen[got] += np.bincount(at, minlength=len(got))
        return got[at]


class Rows:
    """A growing array with one row for each cached word."""

    def __init__(self, width: tuple, dtype):
        self.data = np.zeros((1 << 12, *width), dtype)

    def put(self, start: int, rows: np.ndarray) -> None:
        end = start + len(rows)
        if end > len(self.data):
            bigger = np.zeros((max(end, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            bigger[:start] = self.data[:start]
            self.data = bigger
        self.data[start:end] = rows


# --------------------------------------------------------------------------- hashing

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words given as bytes."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter(map(h, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, per_class: int) -> tuple[list, dict]:
    """A bounded sample of (key, label, text) rows.  The ids are chosen from the narrow label table alone and pushed
    into the scan of the documents, so no text of another is shuffled.  Rows that repeat an id count once for each text,
    of which two are read at most; texts longer than LONGEST_SAMPLED are left out."""
    chosen, counts = sample_per_class(labels.where(F.col(key).isNotNull()), label, key, [key], per_class)
    by_id = {r[2]: r[1] for r in chosen}
    if not by_id:
        return [], counts
    found = docs.where(F.col(key).isin(list(by_id)) & (F.length(text) <= LONGEST_SAMPLED)).groupBy(key).agg(F.min(text).alias("a"), F.max(text).alias("b"))
    return sorted((r[0], by_id[r[0]], t) for r in found.collect() for t in {r["a"], r["b"]}), counts
