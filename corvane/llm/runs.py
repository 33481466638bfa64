r"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q that no neighbouring word extends.  The method, for many documents at
once, in arrays:

1. Names.  Equal stretches of 1, 2, 4, ... words of a document get equal numbers, in lexicographic order (prefix doubling;
   only stretches that still occur twice are named on).  The last names order the suffixes; the longest common extension
   of two places, to the right or to the left, is read off the names from the longest to the shortest.
2. The suffix tree is the suffix order with its common prefixes: a locus is an interval of suffixes and a depth.
3. LZ blocks, each the longest stretch that occurred earlier.  For each block, the two extensions at every distance k up
   to the blocks' lengths give squares; together they cover the leftmost occurrence of every square of the document.
4. Squares of a root that is itself a power are dropped: a run's smallest period has a primitive root.
5. Suffix-link walks from each covering square: to the next suffix, as long as the word that comes in equals the one
   that left, and for one turn of the root at most, since then loci repeat.  Loci met are the vocabulary of squares.
6. A locus' interval holds all occurrences of its square; occurrences with one period at consecutive places merge into runs.

A run at least LEAST long and EXPONENT times its period holds a stretch of LEAST * (EXPONENT - 1) / EXPONENT words at two
places, a period apart.  A document in which no stretch of so many words (of the power of two below) occurs twice has no
such run, and goes no further than the names.

Defined cases: null and empty texts have no words and no runs; repeated rows are worked on alike; ties as the contract
says; very long texts are worked on whole, alone, in memory proportional to their words times the logarithm of their longest
repeat; an empty table gives no rows; the id and the text alone are read, so no other column can clash.  A null id counts as
the empty string where a digest of the id is asked for."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import forget, parts, small_batches

#: Runs reported: at least so many words, and so many times their period.
LEAST, EXPONENT = 24, 3


# --------------------------------------------------------------------------- names, suffixes and extensions


class Names:
    """Names of the stretches of 2**l words of all documents, which lie one after another.  A stretch that leaves its
    document is cut at its end.  `ids` are word numbers, equal for equal words; documents never share a name."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, longest: int | None = None):
        self.n, self.docs = len(ids), docs
        width = int(ids.max(initial=0)) + 2
        self.levels = [_ranks(docs * width + ids + 1)]
        # the first place after a place's document
        self.ends = np.searchsorted(docs, docs, side="right")
        self.lengths = [1]
        while longest is None or self.lengths[-1] < longest:
            if not self._double():
                break

    def _double(self) -> bool:
        """The names of twice the length; False if no name occurs twice."""
        last, step = self.levels[-1], self.lengths[-1]
        open_ = np.flatnonzero(np.bincount(last, minlength=self.n)[last] > 1)
        if not len(open_):
            return False
        beyond = open_ + step
        inside = beyond < self.ends[open_]
        # names of a group lie from its first number on, so numbers of all places stay in lexicographic order
        second = np.where(inside, last[np.minimum(beyond, self.n - 1)] + 1, 0)
        key = last[open_] * np.int64(self.n + 1) + second
        order = np.argsort(key, kind="stable")
        key, at = key[order], open_[order]
        group = last[at]
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
        place = np.arange(len(at))
        first = place[new_key][np.cumsum(new_key) - 1]
        names = last.copy()
        names[at] = group + (first - start)
        self.levels.append(names)
        self.lengths.append(2 * step)
        return True

    def repeats(self, length: int) -> np.ndarray:
        """Documents in which a stretch of `length` words (a power of two up to the longest named) occurs twice."""
        if length not in self.lengths:
            return np.zeros(0, np.int64)  # no stretch occurs twice before
        names = self.levels[self.lengths.index(length)]
        whole = np.arange(self.n) + length <= self.ends
        twice = (np.bincount(names, minlength=self.n)[names] > 1) & whole
        return np.unique(self.docs[twice])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j (j later) on, within the document.  All longest names differ, so each length
        agrees once at most."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        end = self.ends[np.minimum(i, self.n - 1)]
        for names, step in zip(reversed(self.levels), reversed(self.lengths), strict=True):
            ok = j + step <= end
            a, b = np.where(ok, i, 0), np.where(ok, j, 0)
            go = np.where(ok & (names[a] == names[b]), step, 0)
            i += go
            j += go
        return j - start

    def backward(self, i: np.ndarray, j: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many words agree before i and j (exclusive), within the document, whose first place is in `starts`."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for names, step in zip(reversed(self.levels), reversed(self.lengths), strict=True):
            ok = i - step >= starts
            a, b = np.where(ok, i - step, 0), np.where(ok, j - step, 0)
            go = np.where(ok & (names[a] == names[b]), step, 0)
            i -= go
            j -= go
        return begin - i


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Of each key the number of smaller ones."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1]) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


class Tree:
    """The suffix tree of all documents as suffix order, its inverse, and common prefixes of neighbours, with minima
    over blocks of 1, 2, 4, ... of them."""

    def __init__(self, names: Names):
        self.names = names
        self.rank = names.levels[-1]  # all names differ
        self.order = np.empty(names.n, np.int64)
        self.order[self.rank] = np.arange(names.n)
        a, b = self.order[:-1], self.order[1:]
        same = names.docs[a] == names.docs[b]
        lcp = np.zeros(names.n, np.int64)  # of a suffix and the one before it
        lcp[1:][same] = names.forward(np.minimum(a, b)[same], np.maximum(a, b)[same])
        self.minima = _blocks(lcp)

    def interval(self, place: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that begin with the `depth` words at `place`."""
        low, high = self.rank[place].copy(), self.rank[place].copy()
        for level in range(len(self.minima) - 1, -1, -1):
            step, least = 1 << level, self.minima[level]
            # lcp of ranks low-step+1 .. low, and of high+1 .. high+step
            ok = low - step + 1 >= 0
            low = np.where(ok & (least[np.where(ok, low - step + 1, 0)] >= depth), low - step, low)
            ok = high + step < self.names.n
            high = np.where(ok & (least[np.where(ok, high + 1, 0)] >= depth), high + step, high)
        return low, high

    def earlier(self) -> np.ndarray:
        """Of each place the length of the longest stretch that also begins at an earlier place: with the nearest suffix
        on either side that begins earlier."""
        n, order = self.names.n, self.order
        firsts = _blocks(order)
        at = np.arange(n)
        left, right = at - 1, at + 1
        own = order
        for level in range(len(firsts) - 1, -1, -1):
            step, least = 1 << level, firsts[level]
            ok = left - step + 1 >= 0
            left = np.where(ok & (least[np.where(ok, left - step + 1, 0)] > own), left - step, left)
            ok = right + step <= n
            right = np.where(ok & (least[np.where(ok, right, 0)] > own), right + step, right)
        out = np.zeros(n, np.int64)
        for other in (left, right):
            ok = (other >= 0) & (other < n)
            source = order[np.where(ok, other, 0)]
            ok &= (source < own) & (self.names.docs[source] == self.names.docs[own])
            out[own[ok]] = np.maximum(out[own[ok]], self.names.forward(source[ok], own[ok]))
        return out


def _blocks(values: np.ndarray) -> list[np.ndarray]:
    """Minima of values[i : i + 2**l], for every l; those of blocks that go over the end are short of it."""
    levels = [values]
    while (step := 1 << (len(levels) - 1)) * 2 <= len(values):
        last = levels[-1]
        levels.append(np.concatenate([np.minimum(last[:-step], last[step:]), last[-step:]]))
    return levels


# --------------------------------------------------------------------------- squares


def lz_blocks(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each block; a block does not leave its document."""
    longest = np.maximum(tree.earlier(), 1).tolist()
    starts, i, n = [], 0, tree.names.n
    while i < n:
        starts.append(i)
        i += longest[i]
    at = np.array(starts, np.int64)
    return at, np.diff(np.append(at, n))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, 0 .. counts[which] - 1) for every one of the counts."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering_squares(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the leftmost occurrence of every square: those that extensions around each
    block's first place, and the next block's, reveal."""
    names = tree.names
    at, size = lz_blocks(tree)
    firsts = np.searchsorted(names.docs, names.docs, side="left")
    doc_start, doc_end = firsts[at], names.ends[at]
    next_ = at + size
    found = []
    # centres left of the next block's first place
    which, k = _spread(np.where(next_ < doc_end, size, 0))
    k = k + 1
    h1 = next_[which]
    q = h1 - k
    k1 = names.forward(q, h1)
    k2 = names.backward(q, h1, doc_start[which])
    start = np.maximum(q - k2, q - k + 1)
    ok = (k1 + k2 >= k) & (k1 > 0)
    found.append((start[ok], k[ok]))
    # centres right of the block's first place
    following = np.where(next_ < doc_end, np.append(size[1:], 0), 0)
    which, k = _spread(np.minimum(size + following, doc_end - at - 1))
    k = k + 1
    h = at[which]
    q = h + k
    k1 = names.forward(h, q)
    k2 = names.backward(h, q, doc_start[which])
    start = np.maximum(h - k2, h - k + 1)
    ok = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= next_[which])
    found.append((start[ok], k[ok]))
    start, k = (np.concatenate(x) for x in zip(*found))
    both = np.unique(start * np.int64(names.n + 1) + k)
    return both // (names.n + 1), both % (names.n + 1)


def primitive(names: Names, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of each square is no power of a shorter stretch."""
    out = np.ones(len(start), bool)
    rest = period.copy()
    for p in _primes(int(period.max(initial=0))):
        if p > int(rest.max(initial=0)):
            break
        at = np.flatnonzero(rest % p == 0)
        if not len(at):
            continue
        step = period[at] // p
        out[at] &= names.forward(start[at], start[at] + step) < period[at] - step
        while len(at := at[rest[at] % p == 0]):
            rest[at] //= p
        if p * p > int(rest.max(initial=0)):
            break
    at = np.flatnonzero(rest > 1)  # the one prime factor left
    step = period[at] // rest[at]
    out[at] &= names.forward(start[at], start[at] + step) < period[at] - step
    return out


def _primes(most: int) -> list[int]:
    top = int(most**0.5) + 1
    sieve = np.ones(top + 1, bool)
    for p in range(2, int(top**0.5) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return [int(p) for p in np.flatnonzero(sieve) if p > 1]


def runs(ids: np.ndarray, docs: np.ndarray, least: int = LEAST, exponent: int = EXPONENT, at_once: int = 1 << 20) -> np.ndarray:
    """Rows (document, start from the first of all words, length, period) of the runs with at least `least` words and
    `exponent` periods, in order.  `docs` is ascending."""
    empty = np.zeros((0, 4), np.int64)
    if not len(ids):
        return empty
    repeat = 1 << (max(1, least * (exponent - 1) // exponent).bit_length() - 1)
    able = Names(ids, docs, longest=repeat).repeats(repeat)
    if not len(able):
        return empty
    chosen = np.isin(docs, able)
    back = np.flatnonzero(chosen)
    ids, docs = ids[chosen], docs[chosen]
    names = Names(ids, docs)
    tree = Tree(names)

    start, period = covering_squares(tree)
    ok = primitive(names, start, period)
    start, period = start[ok], period[ok]
    # suffix-link walks: each step drops a word and takes one in, while they are equal, for one turn of the root at most
    turns = np.minimum(names.forward(start, start + period) - period, period - 1) + 1
    loci = []
    for a, b in _slices(turns, at_once):
        which, step = _spread(turns[a:b])
        place, depth = start[a:b][which] + step, 2 * period[a:b][which]
        low, high = tree.interval(place, depth)
        loci.append(np.unique(np.stack([low, high, depth // 2], 1), axis=0))
    loci = np.unique(np.concatenate(loci), axis=0) if loci else np.zeros((0, 3), np.int64)

    # all occurrences of the vocabulary, and consecutive ones of a period as one run
    n = np.int64(names.n + 1)
    which, step = _spread(loci[:, 1] - loci[:, 0] + 1)
    seen = np.sort(loci[which, 2] * n + tree.order[loci[which, 0] + step])
    if not len(seen):
        return empty
    first = np.flatnonzero(np.append(True, (seen[1:] != seen[:-1] + 1)))
    last = np.append(first[1:], len(seen)) - 1
    period = seen[first] // n
    start = seen[first] % n
    length = seen[last] - seen[first] + 2 * period
    ok = (length >= least) & (length >= exponent * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, start))
    return np.stack([docs[start], back[start], length, period], 1)[order]


def _slices(counts: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges of the counts whose sums are about `at_once`."""
    cuts = np.unique((np.cumsum(counts) - counts) // at_once, return_index=True)[1].tolist()
    yield from zip(cuts, [*cuts[1:], len(counts)])


# --------------------------------------------------------------------------- documents


def periodic_tail(words: list, h: int) -> list:
    """The contract's planted repetition: from a place on, the words of a period again and again."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[: n - a]


def collapsed(words: list, found: np.ndarray) -> list:
    """Words without those that a run holds after its first period.  found: (start, length, period)."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def digest_row(words: list, found: np.ndarray) -> tuple:
    """(runs, start, length, period, thousandths of the exponent, digest of the runs, digest of the collapsed text)."""
    rows = found.tolist()
    best = None
    for s, l, p in rows:  # in order of start, then period: an equal ratio later never wins
        if best is None or l * best[2] > best[1] * p:
            best = (s, l, p)
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in rows).encode()
    text = b" ".join(collapsed(words, found))
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(rows), *shown, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())


FIELDS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _all_runs(many: list[list]) -> list[np.ndarray]:
    """The (start, length, period) rows of each list of words."""
    numbers = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in many], np.int64)
    ids = np.fromiter((numbers[w] for words in many for w in words), np.int64, int(sizes.sum()))
    found = runs(ids, np.repeat(np.arange(len(many)), sizes))
    found[:, 1] -= (np.cumsum(sizes) - sizes)[found[:, 0]]
    bounds = np.searchsorted(found[:, 0], np.arange(len(many) + 1))
    return [found[bounds[i] : bounds[i + 1], 1:] for i in range(len(many))]


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each run of each document: key, start (word number), length, period."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            ids = b.column(b.schema.get_field_index(key))
            for i, _, texts in parts(b, text):
                found = _all_runs([t.split() if t else [] for t in texts])
                who = np.repeat(np.arange(i, i + len(found)), [len(x) for x in found])
                rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who, pa.int64())), *(pa.array(rows[:, c]) for c in range(3))], names=[key, "start", "length", "period"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start bigint, length bigint, period bigint")


def op12(docs: DataFrame) -> DataFrame:
    """The contract's digest: a tenth of the documents get a periodic tail first."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            for i, j, texts in parts(b, "text"):
                own = ["" if x is None else str(x) for x in ids.slice(i, j - i).to_pylist()]
                many = [periodic_tail(t.split() if t else [], zlib.crc32(x.encode())) for t, x in zip(texts, own, strict=True)]
                rows = [digest_row(w, found) for w, found in zip(many, _all_runs(many), strict=True)]
                types = [*[pa.int64()] * 5, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FIELDS}")
