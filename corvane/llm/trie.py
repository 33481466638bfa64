r"""Exact deduplication by compressed radix tries.

Two texts are copies when they are identical after every character of `[\x20\x09-\x0D]` is deleted.  A normalised text is
filed under its length and content digest.  Each task first inserts its own texts, whole, into a radix trie (path
compressed: a label holds all bytes up to the next branch), whose terminal nodes hold the owner so far and counts, so a
text leaves a task once however often it occurs there.  What leaves is shuffled by length and digest, sorted within
partitions, and inserted again, key by key, into the partition's trie: equality is decided on full byte strings, and
different texts that share length and digest get different terminals.

Memory is bounded by spilling subtrees.  A task's own trie gives its heaviest subtrees out to the shuffle when it holds
more than its budget; they meet their copies there.  After the shuffle keys come in order, so all but the path of the last
key is complete and can be given out and cut off.  One text is held at a time beyond that.  (What waits in between lies in
Spark's shuffle files and its external sorter.)

Members do not travel with the texts: `classes` gives one row for each distinct text, and `assign` joins the narrow
(row, id, characters, length, digest) table to it.  Classes with at least a HOT-th of all rows, so at most HOT of them,
are broadcast; the rest is joined by shuffle, so that no group of copies meets in one task.

The owner of a class, which stays, is the row with the most code points in its original text, then the smallest id
(null last), then, for rows that repeat both, the first row number.  Defined cases: null counts as empty, and
empty texts and those of white space alone are copies of each other; a null id is an id; repeated rows are one class, of
which one row is kept; very long texts are inserted whole; an empty table gives no rows; the id and the text alone are read,
so no other column can clash."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import forget, materialize, parts, small_batches

SPACE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes of labels that a trie holds before it spills subtrees, and bytes of texts given back at once.
TRIE_BYTES, OUT_BYTES = 32 << 20, 1 << 20
#: A class with at least this share (one in so many) of all rows is broadcast.
HOT = 1000


def sha256(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


class Node:
    __slots__ = ("label", "kids", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.kids, self.owner = label, {}, owner


def common(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of a are those of b from `at` on; by halving, so that long labels are compared in blocks."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def merge(held: list, more: list) -> None:
    """[-characters, id is null, id, rows, rows that tie with the owner]: the smaller owner, counts added."""
    held[3] += more[3]
    if held[:3] == more[:3]:
        held[4] += more[4]
    elif more[:2] < held[:2] or (more[:2] == held[:2] and not held[1] and more[2] < held[2]):
        held[:3], held[4] = more[:3], more[4]


class RadixTrie:
    """Path-compressed trie over byte strings; `held` is about the bytes of its labels."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, owner: list) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], owner)
                self.held += len(key) - at + 200
                return
            if not key.startswith(kid.label, at):
                n = common(kid.label, key, at)
                upper = Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[at]] = kid = upper
                self.held += 200
            at += len(kid.label)
            node = kid
        if node.owner is None:
            node.owner = owner
        else:
            merge(node.owner, owner)

    @staticmethod
    def _weight(node: Node) -> int:
        total, open_ = 0, [node]
        while open_:
            x = open_.pop()
            total += len(x.label) + 200
            open_ += x.kids.values()
        return total

    def _give(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        open_ = [(node, prefix)]
        while open_:
            x, before = open_.pop()
            key = before + x.label if x.label else before
            self.held -= len(x.label) + 200
            if x.owner is not None:
                yield key, x.owner
            open_ += ((x.kids[b], key) for b in sorted(x.kids, reverse=True))

    def spill_heaviest(self, budget: int) -> Iterator[tuple[bytes, list]]:
        """Cuts off the heaviest subtrees below the first branching until at most `budget` bytes are held."""
        node, prefix = self.root, b""
        while len(node.kids) == 1 and node.owner is None:
            (node,) = node.kids.values()
            prefix += node.label
        if not node.kids:
            yield from self.drain()
            return
        for byte in sorted(node.kids, key=lambda b: self._weight(node.kids[b]), reverse=True):
            if self.held <= budget:
                return
            yield from self._give(node.kids.pop(byte), prefix)

    def spill_complete(self, header: bytes) -> Iterator[tuple[bytes, list]]:
        """Cuts off all but what begins with `header`, in order of keys."""
        node, at, prefix = self.root, 0, b""
        while at < len(header):
            for byte in sorted(b for b in node.kids if b != header[at]):
                yield from self._give(node.kids.pop(byte), prefix)
            kid = node.kids.get(header[at])
            if kid is None:
                return
            if not header.startswith(kid.label[: len(header) - at], at):
                yield from self._give(node.kids.pop(header[at]), prefix)
                return
            node, at, prefix = kid, at + len(kid.label), prefix + kid.label

    def drain(self) -> Iterator[tuple[bytes, list]]:
        whole, self.root = self.root, Node(b"")
        yield from self._give(whole, b"")
        self.held = 0


# --------------------------------------------------------------------------- classes


def _texts(batch: pa.RecordBatch, text: str, digest: Callable) -> Iterator[tuple[int, list]]:
    """(place, [(code points, normalised text, its digest)]) of a batch's texts, a bounded number of bytes at a time."""
    for i, j, texts in parts(batch, text):
        out = []
        for t in texts:
            body = t.translate(None, SPACE) if t else b""
            out.append((len(t.translate(None, _CONTINUATION)) if t else 0, body, digest(body)))
        yield i, out


def _header(length: int, digest: bytes) -> bytes:
    return struct.pack(">q", length) + digest


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: Callable[[bytes], bytes] = sha256, budget: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct normalised text: length, digest, twins (how many share both), body (null unless there are
    twins), owner (an id), chars (code points of the owner's text), rows, tied (rows with the owner's id and code points).
    Every digest must have the same length."""
    small_batches(docs.sparkSession)
    width = 8 + len(digest(b""))
    kind = docs.schema[key].dataType
    columns = ["length", "digest", "body", "chars", "owner", "rows", "tied"]

    def batch(rows: list, owner_type: pa.DataType, extra: bool) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), owner_type, pa.int64(), pa.int64(), *([pa.int64()] if extra else [])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*columns, *(["twins"] if extra else [])])

    def row(k: bytes, o: list) -> tuple:
        return struct.unpack(">q", k[:8])[0], k[8:width], k[width:], -o[0], None if o[1] else o[2], o[3], o[4]

    def grouped(rows: Iterator[tuple], owner_type: pa.DataType, extra: bool = False) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r in rows:
            out.append(r)
            size += 100 + len(r[2] or b"")
            if size > OUT_BYTES:
                yield batch(out, owner_type, extra)
                out, size = [], 0
        if out:
            yield batch(out, owner_type, extra)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's own texts, each once for as long as its subtree is not spilled."""
        forget()
        trie, id_type = RadixTrie(), pa.int64()

        def given() -> Iterator[tuple]:
            nonlocal id_type
            for b in batches:
                ids = b.column(b.schema.get_field_index(key))
                id_type = ids.type
                for i, texts in _texts(b, text, digest):
                    for k, (chars, body, d) in enumerate(texts, i):
                        x = ids[k].as_py()
                        trie.insert(_header(len(body), d) + body, [-chars, x is None, x, 1, 1])
                    if trie.held > budget:
                        yield from (row(*x) for x in trie.spill_heaviest(budget // 2))
            yield from (row(*x) for x in trie.drain())

        rows = given()
        for first in rows:
            yield from grouped((r for part in ([first], rows) for r in part), id_type)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys in order of length and digest; a header's terminals are given out together."""
        forget()
        trie, id_type = RadixTrie(), pa.int64()

        def numbered(found: Iterator[tuple[bytes, list]]) -> Iterator[tuple]:
            held: list = []
            for k, o in found:
                if held and held[0][0][:width] != k[:width]:
                    yield from close(held)
                    held = []
                held.append((k, o))
            yield from close(held)

        def close(held: list) -> Iterator[tuple]:
            for k, o in held:
                r = row(k, o)
                yield (*r[:2], r[2] if len(held) > 1 else None, *r[3:], len(held))

        def given() -> Iterator[tuple]:
            nonlocal id_type
            for b in batches:
                id_type = b.column(4).type
                for i in range(b.num_rows):
                    length, d, body, chars, x, rows, tied = (b.column(c)[i].as_py() for c in range(7))
                    header = _header(length, d)
                    if trie.held > budget:
                        yield from numbered(trie.spill_complete(header))
                    trie.insert(header + body, [-chars, x is None, x, rows, tied])
            yield from numbered(trie.drain())

        rows = given()
        for first in rows:
            yield from grouped((r for part in ([first], rows) for r in part), id_type, True)

    schema = f"length bigint, digest binary, body binary, chars bigint, owner {kind.simpleString()}, rows bigint, tied bigint"
    partial = docs.select(key, text).mapInArrow(own, schema)
    return partial.repartition("length", "digest").sortWithinPartitions("length", "digest").mapInArrow(whole, schema + ", twins bigint")


def members(docs: DataFrame, text: str, key: str, digest: Callable[[bytes], bytes] = sha256, bodies: bool = False) -> DataFrame:
    """(key, chars, length, digest) of each row, and with `bodies` its normalised text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            ids = b.column(b.schema.get_field_index(key))
            for i, texts in _texts(b, text, digest):
                columns = [ids.slice(i, len(texts)), pa.array([x[0] for x in texts], pa.int64()), pa.array([len(x[1]) for x in texts], pa.int64()), pa.array([x[2] for x in texts], pa.binary())]
                names = ["key", "chars", "length", "digest"]
                if bodies:
                    columns, names = [*columns, pa.array([x[1] for x in texts], pa.binary())], [*names, "body"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, chars bigint, length bigint, digest binary" + (", body binary" if bodies else ""))


def assign(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: Callable[[bytes], bytes] = sha256, budget: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of docs: key, keep_id (the owner's), group_size, kept and digest."""
    found = materialize(classes(docs, text, key, digest, budget), "classes")
    at = ["length", "digest"]
    own = [*at, "owner", F.col("chars").alias("owner_chars"), F.col("rows").alias("group_size"), "tied"]
    n, twins, ties = found.agg(F.sum("rows"), F.count_if(F.col("twins") > 1), F.count_if(F.col("tied") > 1)).first()
    single = found.where("twins = 1")
    rows = materialize(members(docs, text, key, digest).withColumn("_row", F.monotonically_increasing_id()), "members")
    large = F.col("rows") * HOT >= F.lit(n or 0)
    hot = F.broadcast(single.where(large).select(*own))  # at most HOT rows
    cold = single.where(~large).select(*own)
    placed = rows.join(hot, at).unionByName(rows.join(hot.select(*at), at, "left_anti").join(cold, at))
    if twins:  # different texts of one length and digest: only these are joined by their bytes
        several = found.where("twins > 1").select("body", *own)
        again = members(docs, text, key, digest, bodies=True).withColumn("_row", F.lit(-1) - F.monotonically_increasing_id())
        placed = placed.unionByName(again.join(several, [*at, "body"]).drop("body"))
    is_owner = F.col("key").eqNullSafe(F.col("owner")) & (F.col("chars") == F.col("owner_chars"))
    if ties:  # rows that repeat the owner's id and text: the first of them
        placed = materialize(placed, "placed")
        first = placed.where(is_owner & (F.col("tied") > 1)).groupBy(*at, "owner", "owner_chars", "group_size").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_first"))
        placed = placed.join(first, "_row", "left")
        is_owner = is_owner & ((F.col("tied") == 1) | F.coalesce("_first", F.lit(False)))
    return placed.select(F.col("key").alias(key), F.col("owner").alias("keep_id"), "group_size", is_owner.alias("kept"), "digest")


def op11(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    return assign(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept
  FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM r
"""
