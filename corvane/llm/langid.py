"""Language identification by a linear-chain conditional random field.

Words are the chain's tokens.  A word's features are its character n-grams, its affixes (n-grams that include a word
edge) and its place in lexicons of each language's frequent words.  Transitions between the languages of neighbouring
words are learned too: training sequences are spliced from segments of labelled documents, so that switches occur.
Forward-backward gives each word a probability for each language; a document's language is the one with the most
probability over its words that have a letter, its score that share.

Defined cases: null texts and texts without a letter give `und` with score 0; with nothing to learn from, every text
does.  Ties go to the language that comes first by code point.  Repeated rows get equal results; very long texts are
one chain, handled whole; an empty table gives no rows, and a model of an empty table knows no language; columns of the
input named lang_pred, score, lang_spans or certainty give way to the operator's own."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import crf
from corvane.llm.common import LONGEST_SAMPLED, LOWER, Rows, WordCache, append_columns, remainder, sample_per_class, share, split_words

#: Rows of each language that the model is fitted on, at most.
SAMPLE_PER_LANGUAGE = 120
BITS = 17
ORDERS = (1, 2, 3, 4)
LEXICON_WORDS = 300


@dataclass
class LanguageModel:
    langs: list
    weights: np.ndarray  # (2**BITS + 1, languages); the last row is zero
    lexicon: dict  # word in lower case -> row of lexicon_weights
    lexicon_weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray


def ngram_buckets(words: list) -> tuple[list, np.ndarray]:
    """For each n-gram order, the bucket at each position of the words laid end to end; and where each word starts."""
    text = b"\n".join(words).decode("utf-8", "replace").lower()
    codes = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), np.uint32)
    edge = codes == 10
    seen = np.cumsum(edge)
    starts = np.flatnonzero(edge)[:-1]
    out = []
    size = len(codes)
    h = np.zeros(size, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = size - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        bucket = bucket.astype(np.int64)
        if n == 1:
            bucket[edge] = 1 << BITS
        elif n > 2:
            bucket[seen[n - 2 : n - 2 + m] != seen[:m]] = 1 << BITS
        full = np.full(size, 1 << BITS, np.int64)
        full[:m] = bucket
        full[-1] = 1 << BITS
        out.append(full)
    return out, starts


def _lexicon_rows(words: list, lexicon: dict) -> np.ndarray:
    rest = len(lexicon)
    return np.fromiter((lexicon.get(w.translate(LOWER), rest) for w in words), np.int64, len(words))


def _emissions(words: list, m: LanguageModel) -> np.ndarray:
    buckets, starts = ngram_buckets(words)
    out = m.lexicon_weights[_lexicon_rows(words, m.lexicon)].astype(np.float32)
    for b in buckets:
        out += np.add.reduceat(m.weights[b], starts, axis=0)
    return out


def _splice(docs: list, rng: random.Random) -> list:
    """Sequences of (type id, label) whose segments come from two documents in turn; each document is used whole."""
    docs = docs[:]
    rng.shuffle(docs)
    out = []
    for i in range(0, len(docs), 2):
        pair, cut = docs[i : i + 2], [0, 0]
        ids, labels, turn = [], [], 0
        while any(cut[j] < len(pair[j][0]) for j in range(len(pair))):
            j = turn % len(pair)
            step = rng.randint(4, 40)
            part = pair[j][0][cut[j] : cut[j] + step]
            ids += part
            labels += [pair[j][1]] * len(part)
            cut[j] += step
            turn += 1
        out.append((ids, labels))
    return out


def train(rows: list, epochs: int = 30, seed: int = 5) -> LanguageModel:
    """rows: (text, language) pairs.  Maximum likelihood with a small quadratic penalty, by full gradient steps."""
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    types: dict = {}
    docs, used = [], []
    for text, lang in rows:
        words = (text or "").encode("utf-8", "replace").split()
        docs.append(([types.setdefault(w, len(types)) for w in words], langs.index(lang)))
    words = list(types)
    used = np.zeros((max(len(words), 1), max(k, 1)))
    for ids, label in docs:
        np.add.at(used[:, label], ids, 1)
    lexicon: dict = {}
    for label in range(k):
        rank = (used[:, label] * (used[:, label] / np.maximum(used.sum(1), 1)) ** 2).argsort(kind="stable")[::-1]
        for i in rank[:LEXICON_WORDS].tolist():
            if used[i, label] >= 3:
                lexicon.setdefault(words[i].translate(LOWER), len(lexicon))
    p = {
        "w": np.zeros(((1 << BITS) + 1, k), np.float32), "l": np.zeros((len(lexicon) + 1, k), np.float32),
        "t": np.zeros((k, k)), "s": np.zeros(k),
    }
    if not words or k == 0:
        return LanguageModel(langs if words else [], p["w"], lexicon, p["l"], p["t"], p["s"])
    seqs = [s for s in _splice(docs, random.Random(seed)) if s[0]]
    ids = np.concatenate([np.asarray(s[0]) for s in seqs])
    gold = np.concatenate([np.asarray(s[1]) for s in seqs])
    lens = np.array([len(s[0]) for s in seqs])
    buckets, starts = ngram_buckets(words)
    owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(buckets[0]))))
    lex = _lexicon_rows(words, lexicon)
    gold_t, gold_s = crf.gold_pairs(gold, lens, k)
    n = len(ids)
    first = np.cumsum(lens) - lens
    adam = crf.Adam(0.15)
    for _ in range(epochs):
        emit = p["l"][lex].astype(np.float32)
        for b in buckets:
            emit += np.add.reduceat(p["w"][b], starts, axis=0)
        gamma, pair = crf.marginals(emit[ids], lens, p["t"], p["s"], pairs=True)
        delta = gamma.copy()
        delta[np.arange(n), gold] -= 1
        by_type = np.stack([np.bincount(ids, delta[:, j], len(words)) for j in range(k)], 1) / n
        grad = np.zeros_like(p["w"])
        for b in buckets:
            for j in range(k):
                grad[:, j] += np.bincount(b, by_type[owner, j], len(grad))
        grad += 1e-6 * p["w"]
        grad[-1] = 0
        lgrad = np.stack([np.bincount(lex, by_type[:, j], len(p["l"])) for j in range(k)], 1) + 1e-6 * p["l"]
        lgrad[-1] = 0
        adam.step(p, {
            "w": grad, "l": lgrad, "t": (pair - gold_t) / n + 1e-5 * p["t"],
            "s": (gamma[first].sum(0) - gold_s) / len(lens) + 1e-3 * p["s"],
        })
    return LanguageModel(langs, p["w"], lexicon, p["l"], p["t"], p["s"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample: at most `per_language` rows of each language, of at most LONGEST_SAMPLED characters each,
    chosen by hash of the key and the text."""
    rows, _ = sample_per_class(docs.where(F.length(text) <= LONGEST_SAMPLED), lang, key, [text], per_language)
    return train([(r[text], r[lang]) for r in rows])


def _has_letter(word: bytes) -> bool:
    return any(map(str.isalpha, word.decode("utf-8", "replace")))


def labeller(m: LanguageModel):
    """From a list of texts to (words of each text, has-letter of each word, probabilities of each word)."""
    k = max(len(m.langs), 1)
    emit, letter = Rows((k,), np.float32), Rows((), bool)

    def grow(words: list, start: int) -> None:
        emit.put(start, _emissions(words, m) if m.langs else np.zeros((len(words), k), np.float32))
        letter.put(start, np.fromiter(map(_has_letter, words), bool, len(words)))

    cache = WordCache(grow)

    def label(texts: list):
        words, counts = split_words(texts)
        ids = cache.lookup(words)
        gamma = crf.marginals(emit.data[ids], counts, m.trans, m.start)[0] if m.langs else np.ones((len(ids), 1))
        return counts, letter.data[ids], gamma

    return label


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", spans: bool = False, certainty: bool = False) -> DataFrame:
    """docs with lang_pred and score; with `spans` also lang_spans, the runs of words of one language: an array of
    (lang, first_word, n_words) that covers every word; with `certainty` the mean probability of the likeliest label of
    words with a letter, which is high for a text of several languages if each word's is clear."""
    shared = share(docs.sparkSession, model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
        fields.append(T.StructField("lang_spans", T.ArrayType(span)))
    if certainty:
        fields.append(T.StructField("certainty", T.DoubleType()))

    def make():
        m = shared()
        label = labeller(m)

        def kernel(texts: list) -> list:
            counts, letter, gamma = label(texts)
            doc = np.repeat(np.arange(len(texts)), counts)
            mass = np.stack([np.bincount(doc, gamma[:, j] * letter, len(texts)) for j in range(gamma.shape[1])], 1)
            total = np.bincount(doc, letter, len(texts))
            best = mass.argmax(1)
            known = (total > 0) & bool(m.langs)
            pred = [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.minimum(mass[np.arange(len(texts)), best] / np.maximum(total, 1), 1.0), 0.0)
            out = [pred, score]
            if spans:
                out.append(_spans(counts, gamma.argmax(1), m.langs or ["und"]))
            if certainty:
                out.append(np.where(known, np.bincount(doc, gamma.max(1) * letter, len(texts)) / np.maximum(total, 1), 0.0))
            return out

        return kernel

    return append_columns(docs, text, fields, make)


def _spans(counts: np.ndarray, labels: np.ndarray, langs: list) -> list:
    out, at = [], 0
    for n in counts.tolist():
        part = labels[at : at + n]
        at += n
        cuts = np.flatnonzero(np.diff(part)) + 1
        begins = [0, *cuts.tolist()] if n else []
        ends = [*cuts.tolist(), n]
        out.append([{"lang": langs[int(part[a])], "first_word": a, "n_words": b - a} for a, b in zip(begins, ends)])
    return out


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest: learn from two thirds of the labelled rows, predict every row."""
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(~held & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
