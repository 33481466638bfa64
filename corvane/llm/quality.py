r"""Quality rules with line sequence labelling.

A text's \n-split lines that have a word form a chain.  A linear-chain conditional random field marks each line as
content or boilerplate by Viterbi decoding; a document is kept if content lines hold at least half of its words and the
base rules pass.  Line features are shape statistics: lengths, shares of symbols, capitals, digits and separators,
sentence ends, repeats of earlier lines, words in repeated three-word windows, place in the text.

The field is fitted on a bounded sample of documents labelled good or bad.  Lines of good documents are content; lines
of bad ones start as boilerplate and are relabelled by the fitted field in a few rounds, while each bad document keeps
at least one boilerplate line.

Defined cases: null and empty texts have no words and fail the base rule; without labels of both classes every line is
content.  Lines of any length are single tokens of the chain; very long texts are handled whole.  Repeated rows get equal
results; of equal path scores the label that comes first wins; an empty table gives no rows; columns of the input named
like the operator's own give way to them."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import crf
from corvane.llm.common import append_columns, labelled_sample, mix64, share

#: Rows of each quality label that the field is fitted on, at most.
SAMPLE_PER_LABEL = 500
KEEP_SHARE = 0.5
MIN_WORDS = 50

_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_TAIL = (np.arange(256) & 0xC0) == 0x80  # bytes that continue a code point
_SYMBOL = np.isin(np.arange(256), list(b"[#*$%&|<>]"))
_SYMBOL[[ord("["), ord("]")]] = False
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) | (np.arange(256) >= 0xC0)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_BANG = np.isin(np.arange(256), list(b"!?"))
_PUNCT = np.isin(np.arange(256), list(b".,;:'\"()-_/\\=+~@^`{}[]"))
_STOP = np.isin(np.arange(256), list(b".!?:;\"'"))
FEATURES = 17


@dataclass
class Lines:
    """Statistics of the lines with a word of several texts, end to end."""

    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray


def measure(texts: list) -> tuple[dict, Lines]:
    """The base counts of each text, and its lines."""
    n = len(texts)
    body = b"\n".join(t or b"" for t in texts)
    raw = np.frombuffer(body + b"\n", np.uint8)
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], breaks[:-1] + 1])
    line_doc = np.repeat(np.arange(n), [(t or b"").count(b"\n") + 1 for t in texts])
    solid = ~_SPACE[raw]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    # every line has its own line break, so no segment below is empty
    per_line = lambda table: np.add.reduceat(table.astype(np.int32), starts)
    words = per_line(head)
    chars = per_line(solid & ~_TAIL[raw])
    symbols = per_line(_SYMBOL[raw])
    has = words > 0

    repeat_mask = _repeated(body.split(), np.bincount(line_doc, words, n).astype(np.int64))
    line_words = np.concatenate([[0], np.cumsum(words)])
    in_repeat = np.concatenate([[0], np.cumsum(repeat_mask)])
    repeats = in_repeat[line_words[1:]] - in_repeat[line_words[:-1]]

    dup = np.zeros(len(words), bool)
    at = 0
    for t in texts:
        lines = (t or b"").split(b"\n")
        if len(lines) > 1:
            earlier: set = set()
            for i, x in enumerate(lines, at):
                if has[i]:
                    if x in earlier:
                        dup[i] = True
                    else:
                        earlier.add(x)
        at += len(lines)

    by_doc = lambda x: np.bincount(line_doc, x, n).astype(np.int64)
    base = {"n_words": by_doc(words), "word_chars": by_doc(chars), "n_symbols": by_doc(symbols), "n_dup_lines": by_doc(dup), "n_repeat_words": by_doc(repeats)}

    at = np.flatnonzero(has)
    w, c = words[at].astype(float), np.maximum(chars[at], 1).astype(float)
    rest = lambda table: per_line(table[raw])[at]
    letters = np.maximum(rest(_LETTER), 1)
    stops = per_line(_STOP[raw] & np.append(~solid[1:], True))[at]
    doc = line_doc[at]
    first = np.ones(len(at), bool)
    first[1:] = doc[1:] != doc[:-1]
    last = np.append(first[1:], True)[: len(at)]
    features = np.stack([
        np.ones(len(at)), np.log2(1 + w) / 4, w <= 2, (w > 2) & (w <= 6), symbols[at] / c, np.minimum(symbols[at] / w, 3) / 3, rest(_PUNCT) / c,
        rest(_UPPER) / letters, rest(_UPPER) > 0.5 * letters, rest(_DIGIT) / c, rest(_BANG) / w, np.minimum(stops / w, 1), dup[at], first, last, np.minimum(c / w, 30) / 10, repeats[at] / w,
    ], 1).astype(np.float64)
    return base, Lines(doc, words[at].astype(np.int64), features)


def _repeated(words: list, counts: np.ndarray) -> np.ndarray:
    """Which words stand in a three-word window that their text holds twice or more."""
    mask = np.zeros(len(words), bool)
    if len(words) < 3:
        return mask
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(21)
    if len(number) < 1 << 21:
        key = (((ids[:-2] << shift) | ids[1:-1]) << shift) | ids[2:]
    else:
        key = mix64(mix64(mix64(ids[:-2]) + ids[1:-1]) + ids[2:])
    end = 0
    for n in counts.tolist():
        start, end = end, end + n
        if n < 4:
            continue
        own = key[start : end - 2]
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(own, twice)) + start
            for k in range(3):
                mask[hit + k] = True
    return mask


@dataclass
class LineModel:
    weights: np.ndarray  # (features, 2): boilerplate, content
    trans: np.ndarray
    start: np.ndarray


def train(rows: list, rounds: int = 4, steps: int = 80) -> LineModel:
    """rows: (text, quality 0 or 1) pairs."""
    p = {"w": np.zeros((FEATURES, 2)), "t": np.zeros((2, 2)), "s": np.zeros(2)}
    quality = np.array([y for _, y in rows], np.int64)
    if len(set(quality.tolist())) < 2:
        p["w"][0, 1] = 1.0
        return LineModel(p["w"], p["t"], p["s"])
    parts, doc = [], []
    for i, (t, _) in enumerate(rows):
        lines = measure([(t or "").encode("utf-8", "replace")])[1]
        parts.append(lines.features)
        doc.append(np.full(len(lines.doc), i))
    x, doc = np.concatenate(parts), np.concatenate(doc)
    lens = np.bincount(doc, minlength=len(rows))
    first = (np.cumsum(lens) - lens)[lens > 0]
    good = quality[doc] == 1
    gold = good.astype(np.int64)
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    for _ in range(rounds):
        adam = crf.Adam(0.1)
        gold_t, gold_s = crf.gold_pairs(gold, lens, 2)
        for _ in range(steps):
            gamma, pair = crf.marginals(x @ p["w"], lens, p["t"], p["s"], pairs=True)
            delta = gamma.astype(float)
            delta[np.arange(len(gold)), gold] -= 1
            adam.step(p, {
                "w": x.T @ (delta * weight[:, None]) + 1e-4 * p["w"], "t": (pair - gold_t) / len(gold) + 1e-3 * p["t"],
                "s": (gamma[first].sum(0) - gold_s) / len(first) + 1e-2 * p["s"],
            })
        content = gamma[:, 1]
        new = np.where(good | (content > 0.5), 1, 0)
        order = np.lexsort((content, doc))
        worst = order[np.unique(doc[order], return_index=True)[1]]
        new[worst[~good[worst]]] = 0
        if (new == gold).all():
            break
        gold = new
    return LineModel(p["w"], p["t"], p["s"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> LineModel:
    """Fit on a bounded sample: at most `per_label` rows of each label, chosen by hash of the key."""
    rows, _ = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, text, key, per_label)
    return train([(t, y) for _, y, t in rows])


def judge(docs: DataFrame, model: LineModel, text: str = "text", line_labels: bool = False) -> DataFrame:
    """docs with the base counts, base_failed, content_share and kept; with `line_labels` also the labels of the lines
    that have a word, as an array of booleans (true: content)."""
    shared = share(docs.sparkSession, model)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [*(T.StructField(c, T.LongType()) for c in longs), T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    if line_labels:
        fields.append(T.StructField("line_content", T.ArrayType(T.BooleanType())))

    def make():
        m = shared()

        def kernel(texts: list) -> list:
            base, lines = measure(texts)
            lens = np.bincount(lines.doc, minlength=len(texts))
            content = crf.viterbi(lines.features @ m.weights, lens, m.trans, m.start) == 1
            held = np.bincount(lines.doc, lines.words * content, len(texts)) / np.maximum(base["n_words"], 1)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            out = [*(base[c] for c in longs), failed, held, ~failed & (held >= KEEP_SHARE)]
            if line_labels:
                out.append([x.tolist() for x in np.split(content, np.cumsum(lens)[:-1])])
            return out

        return kernel

    return append_columns(docs, text, fields, make)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest."""
    judged = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
