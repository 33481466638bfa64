r"""MinHash near-duplicate detection with confirmed links.

A text's set holds the 64-bit hashes of its distinct shingles of `width` words (words are cut at ASCII white space, A-Z
lower-cased); a shorter text has its whole word sequence as its one shingle.

1. Rows with equal sets (by two digests) form a class.  Everything below works on classes, numbered by their first row.
2. Each has BANDS x ROWS minima under universal multiply-shift hash functions; each band of ROWS minima is a bucket key.
3. Each bucket holds its members against one pivot, which then leaves the bucket.  So a bucket of any size costs a round
   as many candidates as it has members, and a bucket of two or three is settled by one or two rounds.
4. Candidates are verified by size, by signature (the low byte of each minimum) and at last on full sets.
5. Confirmed links are joined into components by alternating large-star and small-star.
6. Buckets that still hold several components get further rounds.  What is open after the last one is compared on full
   sets in blocks of bounded bytes, by a matrix product in each task, so that no candidate is lost to the pivots and no
   list of pairs is made.  Members with more shingles of their own than a link allows are settled before that.

A pair at the least similarity shares no bucket with probability (1 - 0.8**ROWS)**BANDS, about 7e-6, and its signatures
agree too little with probability below 1e-7; nothing else loses a link.

Defined cases: null texts and texts without a word have an empty set and are linked with nothing; a null id is linked
with nothing and has a null component; repeated rows are one class; rows that repeat an id with another text are nodes
of their own; very long texts have sets of all their shingles; ties cannot arise, components and ids decide; an empty
table gives no rows; a table of any size costs the same series of some dozens of small jobs, which is most of the time of
a small one (10 to 20 seconds); other columns of docs are not read, so none can clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, drop, forget, materialize, mix64, parts, word_hashes

BANDS, ROWS = 30, 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Rounds of pivots before the remaining pairs are compared, at most; a round that finds fewer links than one in SPARSE
#: members of open buckets is the last.
PIVOT_ROUNDS, SPARSE = 4, 50
#: Ids of documents that share a bucket are broadcast up to this number.
BROADCAST_IDS = 200_000
#: Documents and shingles of a block in that comparison, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 17

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BAND_SEED = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(texts: list, width: int) -> list:
    """The sorted set of shingle hashes of each text."""
    words, counts = [], []
    for t in texts:
        own = t.translate(LOWER).split() if t else []
        counts.append(len(own))
        words += own
    h = word_hashes(words)
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = mix64(rolled + h[i : i + len(rolled)])
    out, end = [], 0
    for n in counts:
        start, end = end, end + n
        if n >= width:
            out.append(np.unique(rolled[start : end - width + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for x in h[start:end]:
                whole = mix64(whole + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(members: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over a set."""
    low = np.full(len(_A), ~np.uint64(0))
    for i in range(0, len(members), 2048):
        part = members[None, i : i + 2048] * _A[:, None]
        part += _B[:, None]
        np.minimum(low, part.min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def digests(members: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    return int(mix64(members).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix64(members ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64))


def sketch(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, two 64-bit digests of the set, the bucket key of each band, the signature (a byte of each minimum)."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_shingles bigint, h1 bigint, h2 bigint, buckets array<bigint>, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            for i, j, texts in parts(batch, text):
                n, h1, h2, buckets, sig = [], [], [], [], []
                for s in shingles(texts, width):
                    n.append(len(s))
                    if not len(s):
                        h1.append(0), h2.append(0), buckets.append([]), sig.append(b"")
                        continue
                    one, two = digests(s)
                    h1.append(one), h2.append(two)
                    m = signature(s)
                    band = _BAND_SEED.copy()
                    for r in range(ROWS):
                        band = mix64(band + m[r::ROWS])
                    buckets.append(band.astype(np.int64))
                    sig.append(m.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                    names=[key, "n_shingles", "h1", "h2", "buckets", "signature"],
                )

    return docs.select(key, text).mapInArrow(run, schema)


def _least_alike() -> int:
    """Equal minima that a pair must have: 5.5 standard deviations below what the least similarity gives.  Unequal minima
    whose low bytes are equal only raise the count."""
    n, share = BANDS * ROWS, PERCENT / 100
    return int(n * share - 5.5 * (n * share * (1 - share)) ** 0.5)


def _sets(docs: DataFrame, classes: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """(node, members): the full shingle sets of classes (node, h1, h2, id), made anew from the texts of their ids.  The
    ids are broadcast if they are few by count; else the texts are shuffled to them.  A class finds its set by digest,
    so a row that repeats an id with another text cannot stand for it."""
    wanted = classes.select(F.col("id").alias(key)).distinct()
    chosen = docs.select(key, text).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, key, "left_semi").select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for _, _, texts in parts(batch, text):
                made = [s for s in shingles(texts, width) if len(s)]
                pairs = [digests(s) for s in made]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["h1", "h2", "members"])

    made = chosen.mapInArrow(run, "h1 bigint, h2 bigint, members binary").groupBy("h1", "h2").agg(F.first("members").alias("members"))
    return made.join(classes.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "members")


def _confirm(pairs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links: signatures first, then full sets."""
    least = _least_alike()
    side = lambda df, x, c: df.select(F.col("node").alias(x), F.col(c).alias(f"{c}_{x}"))
    both = lambda df, table, c: df.join(side(table, "u", c), "u").join(side(table, "v", c), "v").select("u", "v", f"{c}_u", f"{c}_v")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                b = batch.slice(i, 4096)
                su, sv = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (2, 3))
                b = b.filter(pa.array((su == sv).sum(1) >= least))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                hits = int((y[at] == x).sum())
                good.append(100 * hits >= PERCENT * (len(x) + len(y) - hits))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["u", "v"])

    likely = materialize(both(pairs, signatures, "signature").mapInArrow(alike, "u bigint, v bigint"), "likely", pairs.count(), 10_000)
    links = materialize(both(likely, sets, "members").mapInArrow(linked, "u bigint, v bigint"), "links", likely.count(), 2_000)
    drop(likely)
    return links


def _lone(sets: DataFrame) -> DataFrame:
    """(node, lone): of each set the number of shingles that no other of these sets has, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i, j, members in parts(batch, "members"):
                nodes = np.repeat(batch.column(0).slice(i, j - i).to_numpy(), [len(m) // 8 for m in members])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.frombuffer(b"".join(members), np.int64))], names=["node", "h"])

    rows = sets.select("node", "members").mapInArrow(run, "node bigint, h bigint")
    once = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    return once.groupBy("node").agg(F.count("*").alias("lone"))


def _overlaps(left: list, right: list) -> np.ndarray:
    """The sizes of the intersections of all left sets with all right ones: a product of 0-1 matrices over the shingles
    that two or more of them have, some columns at a time."""
    sizes = np.array([len(x) for x in (*left, *right)])
    _, number, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner, kept = np.repeat(np.arange(len(sizes)), sizes), count[number] > 1
    place = np.cumsum(count > 1) - 1
    owner, column = owner[kept], place[number[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    step = 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (start, start + step))
        m = np.zeros((len(sizes), step), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _first_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n places the first that it reaches by the links i, j."""
    first = np.arange(n)
    while True:
        low = np.minimum(first[i], first[j])
        new = first.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def _in_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join the members of one bucket as all its links between different components do; placed:
    (bucket, node, n, root).  A task ties what its links connect to one member, so it returns no more pairs than it has
    members.

    A bucket's members are dealt into blocks of about BLOCK_ROWS and BLOCK_SHINGLES, those of its largest component apart
    from the others, and pairs of blocks are compared within a task.  Blocks of the largest component are not compared
    with each other, so a bucket costs in proportion to its members times the blocks of the others."""
    per_root = placed.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    main = F.max_by(F.struct("root", "c", "s"), F.struct("s", "root")).alias("main")
    shape = per_root.groupBy("bucket").agg(main, F.sum("c").alias("c"), F.sum("s").alias("s")).where("c > main.c")
    blocks = lambda c, s: F.greatest(F.ceil(c / F.lit(BLOCK_ROWS)), F.ceil(s / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    few, many = blocks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")), blocks(F.col("main.c"), F.col("main.s"))
    shape = shape.select("bucket", F.col("main.root").alias("main"), few.alias("few"), many.alias("many"))
    own = placed.join(shape, "bucket").withColumn("main", F.col("root") == F.col("main"))
    spot = F.when(F.col("main"), F.col("few") + F.pmod(F.xxhash64("node"), "many")).otherwise(F.pmod(F.xxhash64("node"), "few")).cast("int")
    last = F.when(F.col("main"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    dealt = own.withColumn("spot", spot).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    dealt = dealt.select("bucket", F.least("spot", "other").alias("p"), F.greatest("spot", "other").alias("q"), "spot", "node", "root")

    def compare(group: pa.Table) -> pa.Table:
        node, root, spots = (group[c].to_numpy() for c in ("node", "root", "spot"))
        members = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["members"]]
        size = np.array([len(x) for x in members])
        left, right = np.flatnonzero(spots == group["p"][0].as_py()), np.flatnonzero(spots == group["q"][0].as_py())
        us, vs = [], []
        if len(left) and len(right):
            hits = _overlaps([members[i] for i in left], [members[i] for i in right])
            i, j = np.nonzero(100 * hits >= PERCENT * (size[left][:, None] + size[right][None, :] - hits))
            i, j = left[i], right[j]
            apart = root[i] != root[j]
            first = _first_of(len(node), i[apart], j[apart])
            tied = np.flatnonzero(first != np.arange(len(node)))
            us, vs = np.minimum(node[tied], node[first[tied]]), np.maximum(node[tied], node[first[tied]])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    compared = dealt.join(sets, "node").groupBy("bucket", "p", "q").applyInArrow(compare, "u bigint, v bigint")
    return materialize(compared, "links", placed.count(), 1_000)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node with a link can reach, by alternating large-star and small-star
    until nothing changes.  Every round is written to the shared folder."""
    pairs = lambda df: df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges, state = materialize(pairs(links), "edges", links.count()), None
    while True:
        n = edges.count()
        # large-star: every larger neighbour of a node is tied to the smallest node around it
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.least("u", "low").alias("u"), "v")
        # small-star: a node and its smaller neighbours are tied to the smallest of them
        large = materialize(pairs(large), "large", 2 * n)
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(least, "v").select(F.col("low").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        new = materialize(pairs(small.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges", 2 * n)
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        drop(large)
        drop(edges)
        edges = new
        if now == state:
            out = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
            out._corvane_path = edges._corvane_path
            return out
        state = now


def _open(live: DataFrame, roots: DataFrame | None, *more) -> tuple[DataFrame, DataFrame]:
    """live (bucket, node, n) with the root of each node, and of each bucket that holds several roots the aggregates
    `more`."""
    placed = live.withColumn("root", F.col("node")) if roots is None else live.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), *more).where("a <> b").drop("a", "b")
    return placed, several


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of all links so far."""
    if roots is None:
        return components(links)
    out = components(links.union(roots.where("root <> node").select(F.col("root").alias("u"), F.col("node").alias("v"))))
    drop(roots)
    return out


def _within(a: str, b: str):
    """Whether sizes allow a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def cluster(docs: DataFrame, width: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (the smallest reachable key) and kept, one row per row of docs."""
    sketched = materialize(sketch(docs, width, text, key).withColumn("node", F.monotonically_increasing_id()), "sketch")
    filled = sketched.where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    n = sketched.count()
    classes = materialize(filled.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.min(key).alias("id")), "classes", n)
    first = filled.join(classes.select("node"), "node", "left_semi").select("node", F.col("n_shingles").alias("n"), "buckets", "signature")
    first = materialize(first, "first", n, 15_000)
    # aggregates that are joined back are written first, so that a hot bucket's side of the join can be split
    live, roots, tested, sets, held = first.select(F.explode("buckets").alias("bucket"), "node", "n"), None, None, None, BANDS * n

    def sets_of(nodes: DataFrame) -> DataFrame:
        shared = materialize(classes.join(nodes.distinct(), "node", "left_semi"), "shared", n)
        return materialize(_sets(docs, shared, width, text, key), "sets", shared.count(), 2_000)

    for turn in range(PIVOT_ROUNDS):
        # in the first round buckets of like members take the same pivot, so that most of their pairs are the same
        chance = F.xxhash64("node", "bucket", F.lit(turn)) if turn else F.xxhash64("node")
        placed, several = _open(live, roots, F.min_by(F.struct("node", "n", "root"), chance).alias("p"))
        pivots = materialize(several, "pivots", held)
        open_ = materialize(placed.join(pivots, "bucket").where("node <> p.node"), "open", held)
        held = open_.count()
        sets = sets or sets_of(open_.select("node").union(pivots.select("p.node")))
        pairs = open_.where(F.col("root") != F.col("p.root")).where(_within("n", "p.n"))
        pairs = pairs.select(F.least("node", "p.node").alias("u"), F.greatest("node", "p.node").alias("v")).distinct()
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "candidates", held)
        tested = pairs if tested is None else tested.union(pairs)
        found = _confirm(pairs, first, sets)
        roots = _joined(roots, found)
        drop(pivots)
        if turn:
            drop(before)
        live, before = open_.select("bucket", "node", "n"), open_
        if SPARSE * found.count() < held:
            break
    placed, several = _open(live, roots)
    rest = materialize(placed.join(several, "bucket", "left_semi"), "rest", held)
    sets = sets or sets_of(rest.select("node"))
    lone = _lone(sets.join(rest.select("node").distinct(), "node", "left_semi"))
    own = materialize(rest.join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0))), "lone", held)
    # the shingles that only one of two linked sets has are at most (100 - PERCENT) / PERCENT of the smaller set
    low = own.groupBy("bucket").agg(F.min("lone").alias("low"))
    near = own.join(low, "bucket").where(PERCENT * (F.col("lone") + F.col("low")) <= (100 - PERCENT) * F.col("n"))
    roots = _joined(roots, _in_blocks(materialize(near.select("bucket", "node", "n", "root"), "near", held), sets))
    for table in (first, sets, rest, own):
        drop(table)

    placed = classes.join(roots, "node", "left").select("h1", "h2", "id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component"))
    placed = placed.join(least, "root").select("h1", "h2", "component")
    out = sketched.select(key, "n_shingles", "h1", "h2").join(placed, ["h1", "h2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.col("component")).otherwise(F.col(key))
    return out.select(key, "n_shingles", own.alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))


def op5(docs: DataFrame) -> DataFrame:
    """The contract's digest: shingles of four words."""
    return cluster(docs, width=4)


#: Every pair of documents that share a shingle is counted and compared: exact, for small tables.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
n AS (SELECT doc_id, CASE WHEN coalesce(len(x), 0) = 0 THEN []::VARCHAR[] WHEN len(x) < 4 THEN [array_to_string(x, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(x) - 2), lambda i: array_to_string(x[i:i + 3], ' '))) END AS s FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM n WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT rep, len(s) AS size, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS u, b.rep AS v, a.size AS m, b.size AS k, count(*) AS hits FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * hits >= 80 * (m + k - hits)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT rep AS a, rep AS z FROM c UNION SELECT r.a, b.v FROM r JOIN b ON r.z = b.u),
root AS (SELECT a, min(z) AS root FROM r GROUP BY a)
SELECT n.doc_id, len(n.s)::BIGINT AS n_shingles, coalesce(root.root, n.doc_id) AS component_id, n.doc_id = coalesce(root.root, n.doc_id) AS kept
FROM n LEFT JOIN c ON list_sort(n.s) = c.s LEFT JOIN root ON c.rep = root.a
"""
