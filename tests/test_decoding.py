"""Language model, beam search, hotwords and segmentation against enumeration and plain loops."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import beam, charlm, segment

C = F.col


class PlainModel:
    """Interpolated Kneser-Ney by the formula, with loops over all grams."""

    def __init__(self, texts, order):
        self.order, raw = order, Counter()
        for t in texts:
            if t:
                s = charlm.START + t.replace(" ", "|") + charlm.END
                raw.update(s[max(0, i - order + 1) : i + 1] for i in range(1, len(s)))
        self.n = {order: Counter({g: n for g, n in raw.items() if len(g) == order})}
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter({g: n for g, n in raw.items() if len(g) == k})
            for g in self.n[k + 1]:
                self.n[k][g[1:]] += 1
        self.d = {}
        for k in range(1, order + 1):
            c = [sum(v == j for v in self.n[k].values()) for j in (1, 2, 3, 4)]
            self.d[k] = charlm.FALLBACK
            if all(c):
                y = c[0] / (c[0] + 2 * c[1])
                found = (1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2])
                if all(0 <= d <= j for j, d in enumerate(found, 1)):
                    self.d[k] = found
        self.after = defaultdict(list)
        for k in self.n:
            for g, n in self.n[k].items():
                self.after[g[:-1]].append(n)

    def p(self, c, h):
        k = len(h) + 1
        if k > self.order:
            return self.p(c, h[1:])
        low = self.p(c, h[1:]) if h else 1 / (len(self.n[1]) + 1)
        if not self.after[h]:
            return low
        take = lambda n: self.d[k][min(n, 3) - 1] if n else 0
        n = self.n[k][h + c]
        return (n - take(n) + sum(map(take, self.after[h])) * low) / sum(self.after[h])

    def score(self, t):
        s = charlm.START + t.replace(" ", "|") + charlm.END
        return sum(math.log(self.p(s[i], s[max(0, i - self.order + 1) : i])) for i in range(1, len(s)))


RND = random.Random(1)
TEXTS = ["".join(RND.choice("aabbc dé") for _ in range(RND.randint(0, 25))) for _ in range(60)]


@pytest.mark.parametrize("order", [1, 2, 3, 6])
def test_language_model_equals_the_formula(spark, order):
    model = charlm.fit(spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string"), "text", order)
    plain = PlainModel(TEXTS, order)
    asked = ["abc", "", "a b d", "xyz", "aab aab cc", "d" * 9, None, "éé"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, text string")
    want = {i: pytest.approx(plain.score(t)) if t else None for i, t in enumerate(asked)}
    assert {r.i: r.score for r in charlm.score(df, "i", "text", model, order).collect()} == want
    assert {r.i: r.score for r in charlm.score(df, "i", "text", model, order, limit=0).collect()} == want  # by joins
    trie = charlm.Trie.load(model)
    for context in ("\x02", "\x02ab|", "zzz", ""):
        p = np.exp(trie.after(trie.numbers(context)))
        assert p[[i for i in range(trie.size) if i == trie.size - 1 or chr(trie.alphabet[i]) != charlm.START]].sum() == pytest.approx(1)


def test_language_model_of_nothing(spark):
    model = charlm.fit(spark.createDataFrame([("",), (None,)], "text string"), "text", 3)
    df = spark.createDataFrame([(1, "a")], "i int, text string")
    assert model.count() == 0
    assert charlm.score(df, "i", "text", model).first().score is None and charlm.score(df, "i", "text", model, limit=-1).first().score is None


LABELS = ["", " ", "a", "b"]


def posteriors(seed, frames, symbols=4):
    x = np.random.default_rng(seed).normal(size=(frames, symbols)) * 2
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def enumerated(logp):
    """The mass of each text over all alignments."""
    out = {}
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        text = "".join(LABELS[k] for k, _ in itertools.groupby(path) if k)
        out[text] = np.logaddexp(out.get(text, -np.inf), sum(logp[i, k] for i, k in enumerate(path)))
    return out


def test_a_beam_of_all_prefixes_sums_all_alignments():
    for seed in range(6):
        logp = posteriors(seed, 6)
        want = enumerated(logp)
        got = beam.Decoder(LABELS, width=None).decode(logp)
        assert {t: m for t, m, *_ in got} == pytest.approx(want) and [g[4] for g in got] == sorted((g[4] for g in got), reverse=True)
        narrow = beam.Decoder(LABELS, width=25).decode(logp, top=1)[0]
        assert narrow[0] == max(want, key=want.get) and narrow[1] <= want[narrow[0]] + 1e-9


def hot_plain(text, words, weight):
    return weight * sum(w in words for w in text.split(" "))


def test_language_model_and_hotwords_in_the_beam(spark):
    model = charlm.fit(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "text", 3)
    trie, plain, words = charlm.Trie.load(model), PlainModel(TEXTS, 3), {"ab", "abb", "ba"}
    for seed in range(4):
        logp = posteriors(seed, 5)
        want = {t: m + 0.7 * plain.score(t) + 0.5 * len(t.replace(" ", "")) + hot_plain(t, words, 3.0) for t, m in enumerated(logp).items()}
        got = beam.Decoder(LABELS, width=None, lm=trie, alpha=0.7, beta=0.5, hot=beam.Hotwords(words, 3.0)).decode(logp)
        assert {g[0]: g[4] for g in got} == pytest.approx(want)
        for text, mass, lm, hot, _ in got:
            assert mass == pytest.approx(enumerated(logp)[text]) and lm == pytest.approx(plain.score(text)) and hot == hot_plain(text, words, 3.0)
            break


def test_a_begun_hotword_keeps_its_prefix_in_a_narrow_beam():
    p = np.log(np.array([[0.05, 0.05, 0.5, 0.4], [0.8, 0.1, 0.05, 0.05], [0.05, 0.05, 0.3, 0.6], [0.8, 0.1, 0.05, 0.05], [0.05, 0.05, 0.6, 0.3]]))
    assert beam.Decoder(LABELS, width=1).decode(p)[0][0] == "aba"
    assert beam.Decoder(LABELS, width=2, hot=beam.Hotwords(["bab"], 6.0)).decode(p)[0][0] == "bab"
    d = beam.Decoder(LABELS, hot=beam.Hotwords(["bab", "ba"], 6.0))
    b = d.extend(d.root(), 3)
    assert d.score(b) == 3.0 and d.score(d.extend(b, 3)) == 0.0 and d.score(d.extend(d.extend(b, 2), 1)) == 6.0  # half of the shortest, given back, whole


def test_beam_over_a_table(spark, monkeypatch):
    rows = [("u", i, v.tolist()) for i, v in enumerate(posteriors(3, 5))] + [(None, i, v.tolist()) for i, v in enumerate(posteriors(4, 4))] + [("u", 9, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "unit string, t int, logp array<double>").repartition(3)
    got = beam.decode(df, "unit", "t", "logp", LABELS, width=None, top=3).collect()
    for unit, seed, n in (("u", 3, 5), (None, 4, 4)):
        want = sorted(enumerated(posteriors(seed, n)).items(), key=lambda x: -x[1])[:3]
        assert [(r.text, pytest.approx(r.acoustic)) for r in sorted((r for r in got if r.unit == unit), key=lambda r: r["rank"])] == want
    assert len(got) == 6
    model = charlm.fit(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "text", 3)
    n_best = spark.createDataFrame([("u", "ab", -1.0), ("u", "ccc c", -0.5), ("v", "b", -1.0)], "unit string, text string, am double")
    best = beam.rescored(n_best, "unit", "text", "am", model, [0.0, 2.0], order=3).collect()
    assert {(r.alpha, r.unit): r.text for r in best} == {(0.0, "u"): "ccc c", (2.0, "u"): "ab", (0.0, "v"): "b", (2.0, "v"): "b"}
    monkeypatch.setattr(charlm.Trie, "load", classmethod(lambda cls, model: None))
    with pytest.raises(ValueError, match="language model"):
        beam.decode(df, "unit", "t", "logp", LABELS, model=model)


# ------------------------------------------------------------------ segmentation


def plain_segments(logp, utterances, seconds, margin=0.5, span=30):
    """The whole trellis, frame by frame."""
    tokens, owner = [], []
    for u, ids in enumerate(utterances):
        if u:
            tokens.append(0)
            owner.append(-1)
        tokens += ids
        owner += [u] * len(ids)
    n, m = len(logp), len(tokens)
    d = np.full((n + 1, m + 1), -np.inf)
    d[:, 0] = 0
    stayed = np.zeros((n + 1, m + 1), bool)
    for t in range(n):
        for c in range(1, m + 1):
            enter, stay = d[t, c - 1] + logp[t, tokens[c - 1]], d[t, c] + max(logp[t, 0], logp[t, tokens[c - 1]])
            stayed[t + 1, c] = stay > enter
            d[t + 1, c] = max(enter, stay)
    end = int(d[:, m].argmax())
    if not np.isfinite(d[end, m]):
        return None
    t, c, entry, prob = end, m, {}, {}
    while c:
        if stayed[t, c]:
            prob[t - 1] = max(logp[t - 1, 0], logp[t - 1, tokens[c - 1]])
        else:
            prob[t - 1] = logp[t - 1, tokens[c - 1]]
            entry[c - 1] = t - 1
            c -= 1
        t -= 1
    out = []
    for u in range(len(utterances)):
        own = [i for i, x in enumerate(owner) if x == u]
        first, last = entry[own[0]], entry[own[-1]]
        before = entry.get(own[0] - 1, first)
        after = entry.get(own[-1] + 1, end)
        p = [prob[f] for f in range(first, after)]
        score = min(np.mean(p[i : i + span]) for i in range(max(1, len(p) - span + 1)))
        out.append((u, max(first * seconds - margin, (first + before) / 2 * seconds), min(last * seconds + margin, (last + after) / 2 * seconds), score))
    return out


def spoken(rng, utterances, symbols, foreign):
    """Frames in which the utterances are said, with frames of other symbols around them."""
    rows = list(rng.normal(size=(foreign, symbols)))
    for ids in utterances:
        for k in ids:
            for _ in range(rng.integers(1, 4)):
                x = rng.normal(size=symbols)
                x[k] += 5
                rows.append(x)
            if rng.random() < 0.5:
                x = rng.normal(size=symbols)
                x[0] += 5
                rows.append(x)
        x = rng.normal(size=symbols)
        x[0] += 6
        rows.append(x)
    rows += list(rng.normal(size=(foreign, symbols)))
    x = np.array(rows)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


@pytest.mark.parametrize("window", [32, 64, None])
def test_segmentation_equals_the_whole_trellis(window):
    rng = np.random.default_rng(5)
    for _ in range(12):
        utterances = [rng.integers(1, 9, rng.integers(1, 7)).tolist() for _ in range(rng.integers(1, 6))]
        logp = spoken(rng, utterances, 9, int(rng.integers(0, 25)))
        got = segment.segments(logp, utterances, 0.04, window=window)
        want = plain_segments(logp, utterances, 0.04)
        assert [(u, pytest.approx(s), pytest.approx(e), pytest.approx(p)) for u, s, e, p, *_ in got] == want


def test_a_trellis_of_random_frames_and_one_too_short():
    rng = np.random.default_rng(6)
    for n in (3, 10, 40):
        logp = rng.normal(size=(n, 5)) - 3
        utterances = [[1, 2], [2, 2], [4]]
        got, want = segment.segments(logp, utterances, 1.0, window=None), plain_segments(logp, utterances, 1.0)
        assert (got is None) == (want is None) and (want is None or [g[:4] for g in got] == [(u, pytest.approx(s), pytest.approx(e), pytest.approx(p)) for u, s, e, p in want])
    assert segment.segments(logp, [[1], [], [2]], 1.0) is not None and segment.segments(logp, [[]], 1.0) == [] and segment.segments(logp[:0], [[1]], 1.0) is None


def test_segmentation_of_a_table(spark):
    rng = np.random.default_rng(7)
    utterances = [[1, 2, 3], [4, 5], [6, 7, 8, 1]]
    a, b = spoken(rng, utterances, 9, 6), spoken(rng, utterances[:1], 9, 0)
    rows = [("a", i, v.tolist()) for i, v in enumerate(a)] + [(None, i, v.tolist()) for i, v in enumerate(b)] + [("alone", 0, b[0].tolist())]
    frames = spark.createDataFrame(rows, "rec string, t int, logp array<double>").repartition(4)
    texts = spark.createDataFrame([("a", i, u) for i, u in enumerate(utterances)] + [(None, 0, utterances[0]), ("unheard", 0, [1]), ("a", 9, None)], "rec string, n int, ids array<int>")
    got = {(r.rec, r.n): r for r in segment.ctc_segments(frames, texts, "rec", "n", "ids", 0.04).collect()}
    for rec, logp, said in (("a", a, utterances), (None, b, utterances[:1])):
        for u, start, end, score in plain_segments(logp, said, 0.04):
            r = got.pop((rec, u))
            assert (r.start_s, r.end_s, r.score) == (pytest.approx(start), pytest.approx(end), pytest.approx(score))
    assert got == {}
