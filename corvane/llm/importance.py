r"""Target-distribution importance resampling over bucket-partitioned inverted postings.

A text's features are its words and its pairs of neighbouring words, hashed into BUCKETS buckets.  A bucket's gain is
the logarithm of its share in the target corpus over its share in the documents; a document's weight is the mean gain of its
features, and the highest weights with Gumbel noise added are a sample without replacement towards the target.

1. Documents become postings (bucket, document, count), packed by block of documents and range of buckets, and a directory
   row for each document.  Both go to one table in the shared folder, so texts are read once.
2. Counts of each bucket: summed in a task, then by bucket; those of the target corpus beside them.
3. Postings are shuffled by range of buckets and salt (the number of salts follows the number of blocks, so a range is
   spread however many postings it has) to the counts of both corpora for that range, which each group gets; the gains are
   computed there, from these counts and the two totals.
4. Each block of postings emits one contribution for each of its documents; contributions are summed by document.
5. Ranks: rows are counted by score (scores are whole thousandths between bounds that the corpora's sizes set, so there are
   few of them), then numbered within a score by counts of each id and block.

Words are runs of ASCII digits, A-Z lower-cased to a-z, and all characters beyond ASCII.  A pair's hash is made from its
words' own by shifting the first one's checksum past the second, so pairs are never put together as text.

Defined cases: a null or empty text has no features, weight 0, and is not drawn; with an empty target, or no documents, gains
are what the formula gives for counts of 0; a null id draws by a digest of its text and orders after other ids; repeated
rows are scored alike, and tie in order of their place in the input; very long texts are one block; an empty table gives no
rows; the id and the text alone are read, so no other column can clash."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, Rows, WordCache, forget, materialize, parts, small_batches

BUCKETS = 10_000
#: Buckets are dealt in so many ranges; postings of a range go to one salt for each so many blocks.
RANGES, BLOCKS_A_SALT = 16, 256
#: The noise of a draw: its seed, and the share of documents drawn, of those with enough words.
SEED, PERCENT, LEAST_WORDS = 7, 25, 20

_NO_WORD = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(32 if LOWER[i] in _NO_WORD else LOWER[i] for i in range(256))

# --------------------------------------------------------------------------- hashes of words and pairs


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


class Shifts:
    """Checksums of a text followed by another one of n bytes, from those of the two: table n maps each byte of the first
    one's checksum past n bytes."""

    LONGEST = 64

    def __init__(self):
        step = _byte_table()
        x = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        tables = [x]
        for _ in range(self.LONGEST):
            x = (x >> 8) ^ step[x & 255]
            tables.append(x)
        self.tables = np.stack(tables).reshape(-1)

    def past(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = n * 1024
        out = self.tables[at + (crc & 255)]
        for k in range(1, 4):
            out = out ^ self.tables[at + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
        return out


class Features:
    """Buckets of the features of texts, and how many words and features each text has."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.shifts = buckets, Shifts()
        self.alone, self.after, self.size = Rows((), np.uint32), Rows((), np.uint32), Rows((), np.int64)
        self.words: dict = {}  # words too long for the tables, by number
        self.cache = WordCache(self._grow, compact=self._compact)

    def _grow(self, words: list, start: int) -> None:
        self.alone.put(start, np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))
        self.after.put(start, np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words)))
        self.size.put(start, np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
        self.words |= {i: w for i, w in enumerate(words, start) if len(w) >= Shifts.LONGEST}

    def _compact(self, kept: np.ndarray) -> None:
        for rows in (self.alone, self.after, self.size):
            rows.data[: len(kept)] = rows.data[kept]
        self.words = {i: self.words[k] for i, k in enumerate(kept.tolist()) if k in self.words}

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, bucket) of every feature, and each text's number of words."""
        words, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = t.translate(FOLD).split()
                counts[i] = len(w)
                words += w
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
        ids = self.cache.lookup(words)
        who = np.repeat(np.arange(len(texts)), counts)
        one = self.alone.data[ids]
        inner = np.flatnonzero(who[1:] == who[:-1])
        a, b = ids[inner], ids[inner + 1]
        size = self.size.data[b]
        two = self.shifts.past(one[inner], np.minimum(size, Shifts.LONGEST)) ^ self.after.data[b]
        for k in np.flatnonzero(size > Shifts.LONGEST).tolist():
            two[k] = zlib.crc32(b" " + self.words[int(b[k])], int(self.alone.data[a[k]]))
        return np.concatenate([who, who[inner]]), np.concatenate([one, two]).astype(np.int64) % self.buckets, counts


# --------------------------------------------------------------------------- postings


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each in the narrowest type, one after another."""
    small = [_narrow(a) for a in arrays]
    head = np.array([x for a in small for x in (a.itemsize, len(a))], np.uint32)
    return b"".join([bytes([len(small)]), head.tobytes(), *(a.tobytes() for a in small)])


def unpack(data: bytes) -> list[np.ndarray]:
    n, at = data[0], 1 + 8 * data[0]
    out = []
    for itemsize, size in np.frombuffer(data, np.uint32, 2 * n, 1).reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, f"<u{itemsize}", size, at).astype(np.int64))
        at += itemsize * size
    return out


def range_of(buckets: int, ranges: int) -> int:
    """How many buckets a range has."""
    return -(-buckets // ranges)


def postings(docs: DataFrame, text: str, key: str, name: Column, buckets: int, ranges: int) -> DataFrame:
    """Rows of two kinds.  Of a block and range of buckets: (part, block, postings, sums), where `postings` packs the
    number of documents of each bucket, the documents' places in the block and the counts, and `sums` the counts of the buckets.
    Of a document: (block, place, key, name, n_features, n_words)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    width = range_of(buckets, ranges)
    columns = ["part", "block", "postings", "sums", "place", "key", "name", "n_features", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        features = Features(buckets)
        block = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, texts in parts(b, "text"):
                n = j - i
                who, bucket, words = features.of(texts)
                found, count = np.unique(bucket * n + who, return_counts=True)
                bucket, place = found // n, found % n
                cuts = np.searchsorted(bucket, np.arange(0, width * ranges + 1, width))
                rows = []
                for r in range(ranges):
                    one = slice(cuts[r], cuts[r + 1])
                    if one.start < one.stop:
                        own = bucket[one] - r * width
                        sums = np.bincount(own, count[one], width).astype(np.int64)
                        rows.append((r, pack(np.bincount(own, minlength=width), place[one], count[one]), pack(sums)))
                m = len(rows)
                part, held, sums = zip(*rows) if rows else ((), (), ())
                ids, names = (b.column(b.schema.get_field_index(c)).slice(i, n) for c in ("key", "name"))
                n_features = np.where(words > 0, 2 * words - 1, 0)
                values = [
                    pa.array([*part, *[None] * n], pa.int32()), pa.array(np.full(m + n, block), pa.int64()), pa.array([*held, *[None] * n], pa.binary()), pa.array([*sums, *[None] * n], pa.binary()),
                    pa.array([*[None] * m, *range(n)], pa.int32()), pa.concat_arrays([pa.nulls(m, ids.type), ids]), pa.concat_arrays([pa.nulls(m, names.type), names]),
                    pa.array([*[None] * m, *n_features.tolist()], pa.int64()), pa.array([*[None] * m, *words.tolist()], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(values, names=columns)
                block += 1

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), name.alias("name"))
    return rows.mapInArrow(run, f"part int, block bigint, postings binary, sums binary, place int, key {kind}, name string, n_features bigint, n_words bigint")


def _counts(rows: DataFrame, add, buckets: int, name: str) -> DataFrame:
    """(bucket, name): vectors that `add(batch, vector)` fills in each task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        vector = np.zeros(buckets, np.int64)
        take = add()
        for b in batches:
            take(b, vector)
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(vector[at])], names=["bucket", name])

    return rows.mapInArrow(run, f"bucket int, {name} bigint").groupBy("bucket").agg(F.sum(name).alias(name))


def corpus_counts(docs: DataFrame, text: str, buckets: int, name: str) -> DataFrame:
    """(bucket, name): features of all texts in each bucket."""

    def add():
        features = Features(buckets)

        def take(b: pa.RecordBatch, vector: np.ndarray) -> None:
            for _, _, texts in parts(b, text):
                vector += np.bincount(features.of(texts)[1], minlength=buckets)

        return take

    small_batches(docs.sparkSession)
    return _counts(docs.select(text), add, buckets, name)


def posted_counts(posted: DataFrame, buckets: int, ranges: int, name: str) -> DataFrame:
    """The same from the table of postings."""
    width = range_of(buckets, ranges)

    def add():
        def take(b: pa.RecordBatch, vector: np.ndarray) -> None:
            for r, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (own,) = unpack(sums)
                stop = min(width, buckets - r * width)
                vector[r * width : r * width + stop] += own[:stop]

        return take

    return _counts(posted.where("part is not null").select("part", "sums"), add, buckets, name)


def gains(s: DataFrame, t: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of each bucket that the documents have."""
    totals = s.agg(F.sum("s").cast("double").alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t")))  # one row each
    both = s.join(t, "bucket", "left").crossJoin(F.broadcast(totals))
    more, less = (F.coalesce("t", F.lit(0)) + 1).cast("double") * (F.col("all_s") + buckets), (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets)
    return both.select("bucket", F.floor(1000.0 * F.log(more / less)).alias("gain"))


def contributions(posted: DataFrame, s: DataFrame, t: DataFrame, buckets: int, ranges: int, blocks: int) -> DataFrame:
    """(block, part, sums): of each block and range of buckets, what the range adds to each of the block's documents."""
    salts = max(1, -(-blocks // BLOCKS_A_SALT))
    width = range_of(buckets, ranges)
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    # at most `width` counts a range; every salt gets them
    known = gains(s, t, buckets).groupBy((F.col("bucket") / width).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("bucket", "gain"))).alias("gains"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = posted.where("part is not null").select("part", "block", "postings", salt.alias("salt")).join(known.hint("shuffle_hash"), ["part", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            out = []
            for part, packed, found in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                own = np.zeros(width, np.int64)
                pair = found.values
                own[pair.field("bucket").to_numpy() - part * width] = pair.field("gain").to_numpy()
                docs, place, count = unpack(packed)
                gain = np.repeat(own, docs)
                total = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
                np.add.at(total, place, gain * count)
                out.append(total)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["block", "part", "sums"])

    return met.select("part", "block", "postings", "gains").mapInArrow(run, "block bigint, part int, sums array<bigint>")


# --------------------------------------------------------------------------- weights and draws


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """One row for each row of docs: block and place (a row's own number), key, name (what it draws by), n_features,
    n_words and weight, the floored mean of its features' gains."""
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    posted = materialize(postings(docs, text, key, name, buckets, ranges), "postings")
    directory = posted.where("place is not null").select("block", "place", "key", "name", "n_features", "n_words")
    s = materialize(posted_counts(posted, buckets, ranges, "s"), "counts", rows=buckets)
    t = materialize(corpus_counts(target, target_text, buckets, "t"), "target", rows=buckets)
    blocks = posted.where("place = 0").count()
    given = contributions(posted, s, t, buckets, ranges, blocks)
    # the contributions of a block's ranges, summed by place; a range's last places may have none
    sums = F.aggregate("all", F.array().cast("array<bigint>"), lambda a, x: F.zip_with(a, x, lambda u, v: F.coalesce(u, F.lit(0)) + F.coalesce(v, F.lit(0))))
    total = given.groupBy("block").agg(F.collect_list("sums").alias("all")).select("block", F.posexplode(sums).alias("place", "total"))  # one row for each range
    joined = directory.join(total, ["block", "place"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))
    return joined.withColumn("weight", weight.cast("bigint")).drop("total")


def noise(name: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from a digest of the name."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score, and rank of the rows drawn: the given percentage of those with enough words, highest score
    first, ties by key."""
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("name"), seed)), "scored")
    able = F.col("n_words") >= least_words
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))  # one row for each score that occurs
    share = F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / F.lit(100))
    before = by_score.select("score", (F.sum("n").over(higher) - F.col("n")).alias("before"), share.alias("most")).where("before < most")
    met = scored.join(F.broadcast(before), "score", "left")  # scores are whole numbers between bounds
    drawn = met.where(able & F.col("before").isNotNull())
    rest = met.where(~able | F.col("before").isNull()).drop("before", "most").withColumn("rank", F.lit(None).cast("bigint"))
    null = F.col("key").isNull()
    own = drawn.groupBy("score", "key", "block").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("score").orderBy(null, "key", "block").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("score", "key", "block", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("ties"))
    same = (F.col("a.score") == F.col("b.score")) & (F.col("a.block") == F.col("b.block")) & F.col("a.key").eqNullSafe(F.col("b.key"))
    placed = drawn.alias("a").join(own.alias("b"), same).select("a.*", "b.ties")
    nth = F.row_number().over(Window.partitionBy("score", "key", "block").orderBy("place"))
    rank = F.col("before") + F.col("ties") + nth
    ranked = placed.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank"))).drop("before", "most", "ties")
    return ranked.unionByName(rest).withColumnRenamed("key", "doc_id")


def op13(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns."""
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb),
c AS (SELECT 'd' AS src, doc_id AS id, text, row_number() OVER () AS r FROM documents UNION ALL SELECT 'b', item_id, text, row_number() OVER () FROM benchmark),
w AS (SELECT src, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM c),
g AS (SELECT src, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
n AS (SELECT src, r, f, count(*) AS n FROM g GROUP BY ALL),
h AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM n), tab),
p AS (SELECT src, r, b, sum(n)::BIGINT AS n FROM n JOIN h USING (f) GROUP BY ALL),
s AS (SELECT b, sum(n) FILTER (src = 'd') AS own, coalesce(sum(n) FILTER (src = 'b'), 0) AS aim FROM p GROUP BY b),
q AS (SELECT b, floor(1000 * ln(((aim + 1)::DOUBLE * ((SELECT sum(own) FROM s) + 10000)::DOUBLE) / ((own + 1)::DOUBLE * ((SELECT sum(aim) FROM s) + 10000)::DOUBLE)))::BIGINT AS gain FROM s WHERE own IS NOT NULL),
x AS (SELECT r, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS m FROM p JOIN q USING (b) WHERE src = 'd' GROUP BY r),
y AS (SELECT id AS doc_id, len(w.w) AS words, coalesce(m, 0)::BIGINT AS n_features, coalesce((total - ((total % m) + m) % m) // m, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h FROM w LEFT JOIN x USING (r) WHERE src = 'd'),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM y),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE words >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM z WHERE words >= 20) THEN rank END AS rank FROM z LEFT JOIN k USING (doc_id)
"""
