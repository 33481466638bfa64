r"""I-Match document fingerprints.

The lexicon keeps terms whose inverse document frequency lies in a band, that is, whose share of documents lies between
LEAST_SHARE and MOST_SHARE.  A text's fingerprint takes its distinct lexicon terms in sorted order and hashes those of
each of several randomised subsets of the lexicon; subsets are drawn at several rates, so that short and long texts
both have subsets with a few of their terms.  A text without a term in any subset has the hash of all its terms in the
place of the first, so that different texts do not share an empty fingerprint.  Equal texts have equal fingerprints;
likeness is the share of equal hashes among subsets that hold a term of either text (1 if none does).

A document has a bounded number of distinct terms on average, so fewer than (that number / LEAST_SHARE) terms can reach
LEAST_SHARE of all documents: the lexicon has a proven bound however large the corpus is, and is sent to executors as a
sorted array of hashes.  It is found exactly in two passes without shuffling all terms.  Pass 1: each block of documents
reports the terms that reach half that share in it; what blocks leave out of a term is less than half the share, so a
term that reaches it has reports over half of it, and at most twice as many terms do.  Pass 2 counts those everywhere.

Terms are words cut at ASCII white space, A-Z lower-cased.  Defined cases: null and empty texts have no term and the
fingerprint of the empty set; repeated rows have equal fingerprints, and follow each other as next documents; rows of one
id are in order of their text's hash; the next of the last document is the first, so a lone document is its own next;
very long texts are read whole, alone; rows with a null id come first, in one run, and if the first row of all has one they
are all sent a second time, to the last run; an empty table gives no rows; `fingerprint` takes the place of an input column of
that name, and `compare` reads the id and the text alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import LOWER, append_columns, forget, mix64, parts, share, small_batches, word_hashes

#: Terms in fewer or more of the documents than these shares are outside the band.
LEAST_SHARE, MOST_SHARE = 0.001, 0.2
#: Documents of a counting block; terms under a block's share are not reported.
BLOCK_DOCS = 16_384
#: A subset at rate r holds each lexicon term with chance r.
RATES = tuple(1 / 2**k for k in range(4, 12) for _ in range(8))
_SEEDS = mix64(np.arange(1, len(RATES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LIMITS = np.array([int(r * 2**32) for r in RATES], np.uint64)
#: Rows of a group of consecutive documents that one task pairs with their next ones, about.
RUN_ROWS, MAX_RUNS = 1000, 4096


def distinct_terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of every distinct term of each text, texts in order."""
    docs, words = [], []
    for i, t in enumerate(texts):
        if t:
            own = set(t.translate(LOWER).split())
            words += own
            docs.append(np.full(len(own), i))
    return (np.concatenate(docs) if docs else np.zeros(0, np.int64)), word_hashes(words)


def _count_pass(docs: DataFrame, text: str, candidates) -> DataFrame:
    """(term, n) of each block: with `candidates` the document counts of those terms, else of the terms that reach half
    the least share in it; both with one row for term null that counts documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = None if candidates is None else candidates()
        held, n_docs = [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, n_docs
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            term, n = np.unique(h, return_counts=True)
            if known is None:
                keep = n >= LEAST_SHARE / 2 * n_docs
                term, n = term[keep], n[keep]
            terms = pa.array([*term.astype(np.int64).tolist(), None], pa.int64())
            out = pa.RecordBatch.from_arrays([terms, pa.array([*n.tolist(), n_docs], pa.int64())], names=["term", "n"])
            held, n_docs = [], 0
            return out

        for batch in batches:
            for i, j, texts in parts(batch, text):
                _, h = distinct_terms(texts)
                if known is not None and len(known):
                    h = h[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                elif known is not None:
                    h = h[:0]
                held.append(h)
                n_docs += j - i
                if n_docs >= BLOCK_DOCS or sum(map(len, held)) > 4_000_000:
                    yield close()
        if n_docs:
            yield close()

    return docs.select(text).mapInArrow(run, "term bigint, n bigint")


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The sorted hashes of the terms within the band; exact counts over all documents, of bounded size."""
    spark = docs.sparkSession
    reported = _count_pass(docs, text, None).where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    found = reported.where(F.col("n") >= LEAST_SHARE / 2 * docs.count()).select("term").toArrow()  # at most twice the lexicon's bound
    candidates = share(spark, np.sort(found["term"].to_numpy().astype(np.uint64)))
    counted = _count_pass(docs, text, candidates).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted["term"].combine_chunks(), counted["n"].to_numpy()
    documents, real = n[term.is_null().to_numpy(zero_copy_only=False)].sum(), term.is_valid().to_numpy(zero_copy_only=False)
    kept = real & (n >= LEAST_SHARE * documents) & (n <= MOST_SHARE * documents)
    return np.sort(term.fill_null(0).to_numpy()[kept].astype(np.uint64))


class Fingerprinter:
    """Hashes of a text's sorted lexicon terms in each subset; 0 for a subset without any.  A term is in about one
    subset, so work follows (term, subset) pairs and not their product."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.mixed = terms, mix64(terms)
        pairs = [np.flatnonzero((mix64(terms ^ seed) >> np.uint64(32)) < limit) for seed, limit in zip(_SEEDS, _LIMITS, strict=True)]
        term = np.concatenate(pairs)
        order = np.argsort(term, kind="stable")
        self.subsets = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(terms) + 1))
        self.powers = np.cumprod(np.full(len(terms) + 1, 0x9E3779B97F4A7C15, np.uint64))

    def __call__(self, texts: list) -> np.ndarray:
        doc, h = distinct_terms(texts)
        out = self._subsets(len(texts), doc, h)
        if len(bare := np.flatnonzero(~out[doc].any(1))):
            total = np.zeros(len(texts), np.uint64)
            np.add.at(total, doc[bare], mix64(h[bare]))
            out[doc[bare], 0] = np.maximum((mix64(total) >> np.uint64(48)).astype(np.uint16), 1)[doc[bare]]
        return out

    def _subsets(self, n_texts: int, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros((n_texts, len(RATES)), np.uint16)
        if not len(self.terms) or not len(h):
            return out
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        doc, at = doc[known], at[known]
        order = np.lexsort((at, doc))  # the terms of each text in sorted order
        doc, at = doc[order], at[order]
        n = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return out
        subset = self.subsets[np.repeat(self.bounds[at] - (ends - n), n) + np.arange(ends[-1])]
        group, at = np.repeat(doc, n) * len(RATES) + subset, np.repeat(at, n)
        order = np.argsort(group, kind="stable")  # keeps the terms of a subset sorted
        group, at = group[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        # a polynomial over each subset's terms: the term's hash times a power by its place in the subset
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        total = np.add.reduceat(self.mixed[at] * self.powers[place], starts)
        out.reshape(-1)[group[starts]] = np.maximum((mix64(total) >> np.uint64(48)).astype(np.uint16), 1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of subset hashes: equal ones over those that either has."""
    either = (a != 0) | (b != 0)
    return np.where(either.any(1), ((a == b) & either).sum(1) / np.maximum(either.sum(1), 1), 1.0)


def hexed(f: np.ndarray) -> list:
    return [row.tobytes().hex() for row in f.astype(">u2")]


def fingerprint(docs: DataFrame, terms: np.ndarray, text: str = "text") -> DataFrame:
    """docs with fingerprint, the hexadecimal hashes of all subsets."""
    shared = share(docs.sparkSession, terms)

    def make():
        f = Fingerprinter(shared())
        return lambda texts: [hexed(f(texts))]

    return append_columns(docs, text, [T.StructField("fingerprint", T.StringType())], make)


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(run, tail, key, text): rows dealt into runs of consecutive keys.  The first row of each run is also sent to the
    run before it (the first of all to the last), marked as tail, so that each run holds the next of all its rows.
    Only the runs' bounds, MAX_RUNS numbers at most, come to the driver."""
    spark = docs.sparkSession
    runs = min(MAX_RUNS, max(1, -(-docs.count() // RUN_ROWS)))
    cuts = docs.where(F.col(key).isNotNull()).approxQuantile(key, [i / runs for i in range(1, runs)], 0.25 / runs) if runs > 1 else []
    bounds = F.array(*(F.lit(b) for b in sorted({int(c) for c in cuts}))) if cuts else F.array().cast("array<bigint>")
    run = F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(key)))).cast("int")
    placed = docs.select(key, text).withColumn("run", run)
    firsts = {r["run"]: r["first"]["v"] for r in placed.groupBy("run").agg(F.min(F.struct(F.col(key).isNotNull().alias("k"), F.col(key).alias("v"))).alias("first")).collect()}
    order = sorted(firsts)
    kind = docs.schema[key].dataType.simpleString()
    heads = spark.createDataFrame([(firsts[r], r, order[i - 1]) for i, r in enumerate(order)], f"head {kind}, at int, to int")
    tails = placed.join(F.broadcast(heads), (F.col("run") == F.col("at")) & F.col(key).eqNullSafe(F.col("head")))
    return placed.select("run", F.lit(False).alias("tail"), key, text).union(tails.select(F.col("to").alias("run"), F.lit(True).alias("tail"), key, text))


def compare(docs: DataFrame, terms: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's fingerprint held against those of its edited text and of the next document."""
    shared = share(docs.sparkSession, terms)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter(shared())
        last = None  # a row whose next one has not come yet
        for batch in batches:
            tails, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j, texts in parts(batch, text):
                rows = [last] if last is not None else []
                rows += [(tail, k, t or b"") for tail, k, t in zip(tails[i:j], keys[i:j], texts, strict=True)]
                last = rows[-1]
                prints = of([r[2] for r in rows])
                plain = [r[2].decode("utf-8", "replace") for r in rows]
                at = [k for k in range(len(rows) - 1) if not rows[k][0]]
                if not at:
                    continue
                changed = [edited(plain[k], plain[k + 1]).encode() for k in at]
                own, after, other = prints[at], prints[[k + 1 for k in at]], of(changed)
                columns = [
                    pa.array([rows[k][1] for k in at], batch.column(2).type), pa.array([len(plain[k]) for k in at], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
                    pa.array(hexed(own)), pa.array(hexed(other)), pa.array(likeness(own, other)), pa.array(likeness(own, after)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    dealt = with_next(docs, text, key).repartition("run").sortWithinPartitions("run", "tail", F.col(key).asc_nulls_first(), F.xxhash64(text))
    return dealt.mapInArrow(run, f"{key} {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return compare(docs.select("doc_id", "text"), lexicon(docs))
