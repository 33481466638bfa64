"""Alignments that need a traceback: bit-parallel kernels behind Arrow UDFs."""

from __future__ import annotations

import bisect
from collections import Counter

from pyspark.sql import types as T

from corvane.functions.batch import by_slices


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I = T.StringType(), T.IntegerType()
OPS = T.ArrayType(_struct(op=_S, ri=_I, hi=_I, rc=_S, hc=_S))
COUNTS = T.ArrayType(_struct(op=_S, rc=_S, hc=_S, n=T.LongType()))
CODES = T.ArrayType(_struct(tag=_S, i1=_I, i2=_I, j1=_I, j2=_I))


#: Columns of an alignment whose bit vectors are held at once; of a wider one each block's first column is kept.
BLOCK = 512


class _Columns:
    """Unit-cost edit distances of a reference (rows) and a hypothesis (columns), a column at a time: bit i of an integer
    stands for row i + 1, so a column costs a few operations on long integers (Hyyro's bit-parallel algorithm)."""

    def __init__(self, ref, hyp):
        self.hyp, self.rows, self.places = hyp, len(ref), {}
        for i, x in enumerate(ref):
            self.places[x] = self.places.get(x, 0) | 1 << i
        self.all = (1 << self.rows) - 1

    def run(self, up: int, down: int, start: int, end: int):
        """Of each column from start up to end: (rows whose diagonal step is free, rows one above the row before, rows
        one below it)."""
        full, places = self.all, self.places
        for x in self.hyp[start:end]:
            same = places.get(x, 0)
            free = (((same & up) + up) ^ up | same | down) & full
            right, left = down | ~(free | up) & full, up & free
            right, left = (right << 1 | 1) & full, left << 1 & full
            up, down = left | ~(free | right) & full, right & free
            yield free, up, down


def distance(ref, hyp) -> int:
    """Unit-cost edit distance of two sequences of hashable symbols."""
    c = _Columns(ref, hyp)
    up, down = c.all, 0
    for _, up, down in c.run(up, down, 0, len(hyp)):
        pass
    return len(hyp) + up.bit_count() - down.bit_count()


@by_slices(_I)
def list_distance(a, b):
    """Unit-cost edit distance of two arrays of strings, or of two strings' characters; null if either is."""
    return None if a is None or b is None else distance(a, b)


def trace(ref, hyp) -> list[tuple]:
    """(op, ri, hi) from left to right.  Equal symbols match; otherwise substitution before deletion before insertion.
    Memory is that of BLOCK columns and of one column for each block."""
    i, j = len(ref), len(hyp)
    out = []
    while i and j and ref[i - 1] == hyp[j - 1]:
        i, j = i - 1, j - 1
        out.append(("M", i, j))
    c = _Columns(ref[:i], hyp[:j])
    heads, state = [], (c.all, 0)
    for start in range(0, j, BLOCK):
        heads.append(state)
        if start + BLOCK < j:
            for _, *state in c.run(*state, start, start + BLOCK):
                pass
    for start in range((len(heads) - 1) * BLOCK, -1, -BLOCK):
        if not i:
            break
        block = list(c.run(*heads[start // BLOCK], start, min(start + BLOCK, j)))
        while i and j > start:
            free, up, _ = block[j - 1 - start]
            row = 1 << i - 1
            if ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
                out.append(("M", i, j))
            elif not free & row:
                i, j = i - 1, j - 1
                out.append(("S", i, j))
            elif up & row:
                i -= 1
                out.append(("D", i, -1))
            else:
                j -= 1
                out.append(("I", i - 1, j))  # ri: the reference symbol before it, -1 at the start
    out += [("I", -1, k) for k in range(j - 1, -1, -1)] if not i else [("D", k, -1) for k in range(i - 1, -1, -1)]
    return out[::-1]


def _ops(ref, hyp) -> list:
    return [(o, i, j, ref[i] if o != "I" else None, hyp[j] if o != "D" else None) for o, i, j in trace(ref, hyp)]


@by_slices(OPS)
def char_ops(ref, hyp):
    return _ops(ref or "", hyp or "")


@by_slices(COUNTS)
def char_op_counts(ref, hyp):
    """How often a pair's alignment has each operation on each pair of characters."""
    r, h = ref or "", hyp or ""
    found = Counter((o, r[i] if o != "I" else None, h[j] if o != "D" else None) for o, i, j in trace(r, h))
    return [(*k, n) for k, n in found.items()]


@by_slices(OPS)
def word_ops(ref, hyp):
    return _ops((ref or "").split(), (hyp or "").split())


@by_slices(_struct(n_words=_I, bad_strict=_I, bad_lenient=_I, n_ins=_I))
def spaceless(ref, hyp):
    """Segmentation-free word damage: characters are aligned without spaces; a reference word is damaged by a changed or
    missing character, strictly also by an insertion after one of its characters (at the start: the first word)."""
    own = (ref or "").split()
    owner = [i for i, w in enumerate(own) for _ in w]
    strict, lenient, inserted = set(), set(), 0
    if own:
        for op, i, _ in trace("".join(own), "".join((hyp or "").split())):
            if op in "SD":
                lenient.add(owner[i])
            elif op == "I":
                strict.add(owner[max(i, 0)])
                inserted += 1
    return (len(own), len(strict | lenient), len(lenient), inserted)


def matching_blocks(a, b) -> list[tuple[int, int, int]]:
    """(i, j, n): equal blocks of two sequences in order: the longest common one, of equals the first in a, then in b; then
    those to its left and to its right, and so on; neighbours are one block.  These are difflib's blocks without junk.  Bit j
    of an integer says that a block of some size ends at place j of b; the size is doubled, then refined."""
    places = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    rows = [places.get(x, 0) for x in a]
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i1, i2, j1, j2 = todo.pop()
        every = (1 << j2 - j1) - 1
        ends = {i: v for i in range(i1, i2) if (v := rows[i] >> j1 & every)}
        if not ends:
            continue

        def longer(ends: dict, by: dict, n: int) -> dict:
            """Where blocks end that are those of `ends`, followed by one of n that ends in `by`."""
            return {i: v for i, x in by.items() if (y := ends.get(i - n)) and (v := x & y << n)}

        n, smaller = 1, []
        while more := longer(ends, ends, n):
            smaller.append((n, ends))
            ends, n = more, 2 * n
        for m, own in reversed(smaller):
            if more := longer(ends, own, m):
                ends, n = more, n + m
        i = min(ends)
        i, j = i - n + 1, j1 + (ends[i] & -ends[i]).bit_length() - n
        found.append((i, j, n))
        if i1 < i and j1 < j:
            todo.append((i1, i, j1, j))
        if i + n < i2 and j + n < j2:
            todo.append((i + n, i2, j + n, j2))
    out = []
    for i, j, n in sorted(found):
        if out and (i, j) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def opcodes(a, b) -> list[tuple]:
    """(tag, i1, i2, j1, j2): what makes b of a: equal, replace, delete or insert."""
    out, i, j = [], 0, 0
    for x, y, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + n, y + n
        if n:
            out.append(("equal", x, i, y, j))
    return out


@by_slices(T.DoubleType())
def match_ratio(a, b):
    """Ratcliff-Obershelp similarity of characters."""
    a, b = a or "", b or ""
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


@by_slices(CODES)
def char_opcodes(a, b):
    return opcodes(a or "", b or "")


@by_slices(CODES)
def word_opcodes(a, b):
    return opcodes((a or "").split(), (b or "").split())


@by_slices(T.ArrayType(_S))
def onto(backbone, other):
    """For each backbone character what the other text has there; '' where it has nothing."""
    a, b = backbone or "", other or ""
    row = [""] * len(a)
    for tag, i1, i2, j1, j2 in opcodes(a, b):
        if tag in ("equal", "replace"):
            for k in range(min(i2 - i1, j2 - j1)):
                row[i1 + k] = b[j1 + k]
    return row


def _unit_ops(ref: list, hyp: list) -> list:
    names = {"M": "match", "S": "sub", "D": "del"}
    return [(names[op], hyp[j] if op == "S" else "") for op, _, j in trace(ref, hyp) if op != "I"]


@by_slices(T.ArrayType(T.ArrayType(_struct(kind=_S, heard=_S))))
def unit_ops(ref, decodes):
    """Of each reference unit what each decode, an array of units, has: match, sub (with the unit heard) or del."""
    return list(zip(*(_unit_ops(ref or [], d or []) for d in decodes)))



#: Texts whose lengths' product is at most this are aligned by longest common blocks at once; longer ones between seeds.
BLOCK_PRODUCT, SEED, SHORTEST_SEED = 4_000_000, 32, 8


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest rising chain of (i, j) pairs that are in order of i."""
    tails, ends, before = [], [], [-1] * len(pairs)
    for x, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        before[x] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [j], [x]
    out, x = [], ends[-1] if ends else -1
    while x >= 0:
        out.append(pairs[x])
        x = before[x]
    return out[::-1]


def common_blocks(a: str, b: str, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(i, j, n): equal blocks of two texts in order.  Short texts: the longest common block, then those to its left and
    right, and so on.  Long ones: stretches of `seed` characters that occur once in each are chained, extended to all
    equal characters around, and what lies between is aligned in the same way with seeds of half the length; without seeds
    of SHORTEST_SEED it is aligned at once.  So time follows the texts' lengths where they have stretches in common."""
    if len(a) * len(b) <= BLOCK_PRODUCT or seed < SHORTEST_SEED:
        return matching_blocks(a, b)

    def once(s: str) -> dict:
        found: dict = {}
        for i in range(len(s) - seed + 1):
            k = s[i : i + seed]
            found[k] = -1 if k in found else i
        return found

    there = once(b)
    pairs = [(i, j) for k, i in once(a).items() if i >= 0 and (j := there.get(k, -1)) >= 0]  # in order of i
    out, at, bt = [], 0, 0
    for i, j in [*_chain(pairs), (len(a), len(b))]:
        if i < at or j < bt:
            continue  # inside the block before, or across it
        n = 0
        if i < len(a):
            while i > at and j > bt and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
        out += [(at + x, bt + y, m) for x, y, m in common_blocks(a[at:i], b[bt:j], seed // 2)]
        if n:
            out.append((i, j, n))
        at, bt = i + n, j + n
    return out


def anchor(segments: list[str], ref: str) -> list[tuple[str, float]]:
    """Each segment's span of the reference by one alignment of all segments, widened to word edges, and its character
    error rate; ('', 1.0) if nothing of it is found."""
    joined = "".join(s + " " for s in segments)
    owner = [i for i, s in enumerate(segments) for _ in range(len(s) + 1)]
    low, high = {}, {}
    for a, b, n in common_blocks(joined, ref):
        for k in range(n):
            i = owner[a + k]
            low[i], high[i] = min(low.get(i, b + k), b + k), max(high.get(i, b + k), b + k)
    out = []
    for i, s in enumerate(segments):
        if i not in low:
            out.append(("", 1.0))
            continue
        start, end = ref.rfind(" ", 0, low[i]) + 1 if low[i] else 0, ref.find(" ", high[i] + 1)
        span = ref[start : len(ref) if end < 0 else end].strip()
        x, y = s.replace(" ", ""), span.replace(" ", "")
        out.append((span, distance(y, x) / len(y) if y else 1.0))
    return out
