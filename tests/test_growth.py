"""What a query holds does not follow its input: memory of slices and blocks, joins, values made once, open sessions."""

import difflib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.functions import align, text
from corvane.operators import beam, charlm, lexicon, metrics, posterior
from corvane.streaming import quota, stateful


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_deletion_keys_of_many_words_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "BROADCAST_WORDS", 1)
    left = spark.createDataFrame([("kot",), ("lion",)], "word string")
    known = spark.createDataFrame([("cot", 3), ("line", 2), ("zzzz", 9)], "word string, freq bigint")
    found = lexicon.fuzzy(left, known)
    assert {(r.word, r.cand, r.dist) for r in found.collect()} == {("kot", "cot", 1), ("lion", "line", 2)}
    assert "SortMergeJoin [key" in plan(found) and "BroadcastHashJoin [key" not in plan(found)


def test_only_near_misses_need_candidates(spark):
    pairs = spark.createDataFrame([("the cot is far", "the kot is distant"), ("a line", "a lion")], "ref string, hyp string")
    assert {r.word for r in lexicon.near_misses(pairs).collect()} == {"kot", "lion"}


def test_sessions_are_whole(spark, tmp_path):
    rows = [("u", 0), ("u", 600), ("u", 50_000), ("v", 200_000), ("v", 200_100), (None, 200_050)]
    spark.createDataFrame(rows, "u string, at bigint").select("u", F.timestamp_seconds("at").alias("ts")).write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "e"))
    got = quota.sessions(source, "u", "ts", "1 hour", "whole", base=f"file://{tmp_path}/base")
    seen = {(r.u, r.a, r.b, r.n) for r in got.select("u", F.unix_seconds("start").alias("a"), F.unix_seconds("end").alias("b"), "n").collect()}
    assert seen == {("u", 0, 4200, 2), ("u", 50_000, 53_600, 1), ("v", 200_000, 203_700, 2), (None, 200_050, 203_650, 1)}


def test_results_are_given_back_by_slices():
    refs, hyps = pa.array(["many words of one turn " * 100] * 500), pa.array(["many other words of a turn " * 100] * 500)
    for f in (align.word_ops, align.char_op_counts, align.unit_ops):
        args = (pa.array([x.split() for x in refs.to_pylist()]), pa.array([[x.split()] for x in hyps.to_pylist()])) if f is align.unit_ops else (refs, hyps)
        parts = f.func(iter([args]))
        first = next(parts)
        assert 0 < len(first) < 200
    assert len(next(text.nfc.func(iter([refs])))) < 500
    rows = list(text.nfkd_ascii.func(iter([pa.array(["é", None, ""])])))
    assert [x for p in rows for x in p.to_pylist()] == ["e", None, ""]


def turns(n: int) -> list[tuple]:
    """(role, ref, hyp) of about 500 characters each, so that a batch of them is many slices."""
    r, known = random.Random(n), [a + b for a in ("ka", "lo", "mire", "tun") for b in ("", "s", "ta", "ren", "vo")]
    text = lambda: " ".join(r.choices(known, k=r.randint(60, 140)))
    return [(r.choice("xyz"), text(), r.choice((text(), "", None))) for _ in range(n)]


def test_aligned_words_are_held_by_slices():
    """Four times the pairs of a batch take no more memory in a worker, and no more is given back at once."""

    def most(n: int) -> tuple[int, int]:
        batch = tuple(pa.array(c, pa.string()) for c in list(zip(*turns(n)))[1:])
        tracemalloc.start()
        given = max(part.nbytes for part in align.word_ops.func(iter([batch])))
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return held, given

    (held, given), (held4, given4) = most(500), most(2000)
    assert held4 < 1.2 * held < 20_000_000 and given4 < 1.2 * given < 5_000_000


def test_positions_of_a_batch_of_many_slices(spark):
    rows = turns(1000)
    found = metrics.position_errors(spark.createDataFrame(rows, "role string, ref string, hyp string").coalesce(1), "role")
    n, errors = Counter(), Counter()
    for role, ref, hyp in rows:
        for op, i, _ in align.trace(ref.split(), (hyp or "").split()):
            if op != "I":
                n[role, min(i, 7)] += 1
                errors[role, min(i, 7)] += op != "M"
    assert {(r.role, r.position): (r.n, r.errors, r.rate) for r in found.collect()} == {k: (n[k], errors[k], errors[k] / n[k]) for k in n}


def test_accuracy_of_a_batch_of_many_slices(spark):
    rows = turns(1001)
    found = metrics.word_accuracy(spark.createDataFrame(rows, "role string, ref string, hyp string").coalesce(1), "role")
    n, same, close = Counter(), Counter(), Counter()
    for role, ref, hyp in rows:
        r, h = ref.split(), (hyp or "").split()
        for op, i, j in align.trace(r, h):
            n[role] += op != "I"
            same[role] += op == "M"
            close[role] += op in "MS" and align.distance(r[i], h[j]) <= 1
    assert any(close[k] > same[k] for k in n)
    got = {r.role: (r.n, round(r.word_accuracy, 12), round(r.within_one, 12)) for r in found.collect()}
    assert got == {k: (n[k], round(same[k] / n[k], 12), round(close[k] / n[k], 12)) for k in n}


def test_blocks_are_those_of_difflib():
    r = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(r.choices("abcd"[: r.randint(1, 4)], k=r.randint(0, 30))) for _ in "ab")
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert align.matching_blocks(a, b) == [tuple(x) for x in m.get_matching_blocks() if x.size]
        assert align.opcodes(a.split("c"), b.split("c")) == difflib.SequenceMatcher(None, a.split("c"), b.split("c"), autojunk=False).get_opcodes()


def test_alignment_of_many_frames_holds_blocks():
    r = np.random.default_rng(1)
    logp, ids = r.normal(size=(2000, 6)), r.integers(1, 6, 700).tolist()
    tracemalloc.start()
    path = posterior.best_path(logp, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_500_000 and path.max() == 699 and (np.diff(path[path >= 0]) >= 0).all()


def test_values_of_percentiles_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        made.add(1)
        return float(x)

    got = metrics.percentiles(spark.range(101).select(value("id").alias("v")), "v").first()
    assert (got.p50, got.p99, got.mean, made.value) == (50.0, 99.0, 50.0, 101)


def test_words_are_not_shuffled_by_document(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "c d"), (None, "e"), (3, None), (4, ""), (2, "a g")], "k bigint, t string")
    gloss = spark.createDataFrame([("d",)], "word string")
    got = lexicon.oov_once(docs, "k", F.col("t"), gloss)
    assert {(r.k, r.tokens, r.oov_rate) for r in got.collect()} == {(1, 4, 0.0), (2, 4, 0.25), (None, 1, 1.0)}
    counts = lexicon.counted(docs, "k", F.col("t"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in lexicon.oov_of(counts, "k", lexicon.weighted(counts, gloss)).collect()}
    assert not any("word" in x and "key" in x.lower() for x in plan(got).split("\n") if "hashpartitioning" in x)


def test_claims_hold_a_run_and_ask_little(spark, tmp_path, monkeypatch):
    """The same hand-outs with small runs, over two micro-batches, as by one list."""

    class State(dict):
        asked = 0

        def exists(self):
            return bool(self)

        def containsKey(self, k):
            State.asked += 1
            return k in self

        def getValue(self, k):
            State.asked += 1
            return self[k]

        def updateValue(self, k, v):
            State.asked += 1
            self[k] = v

        def removeKey(self, k):
            del self[k]

        def iterator(self):
            return iter(self.items())

        def get(self):
            return self["v"]

        def update(self, v):
            self["v"] = v

    class Handle:
        def getMapState(self, *_):
            return State()

        getValueState = getMapState

    r = random.Random(5)
    acts = [(i, i, f"w{r.randrange(5)}", r.choice(["add", "next", "save", "next"]), f"i{r.randrange(i // 2 + 1)}") for i in range(3000)]
    items, who, done, want = [], {}, set(), {}
    for at, seq, w, act, item in acts:
        if act == "add" and item not in items:
            items.append(item)
        elif act == "save":
            done.add(item)
            who.pop(item, None)
        elif act == "next":
            pick = next((x for x in items if x not in done and (x not in who or who[x][0] == w or at - who[x][1] >= 50)), None)
            if pick:
                who[pick] = (w, at)
            want[seq] = pick
    asked = []
    for run in (100, 200_000):
        monkeypatch.setattr(stateful, "RUN", run)
        State.asked = 0
        p = stateful._Claims("m", 50)
        p.init(Handle())
        got = {}
        for part in (acts[:1700], acts[1700:]):
            for f in p.handleInputRows(("q",), iter([pd.DataFrame(part, columns=["at", "seq", "worker", "action", "item"])]), None):
                got |= dict(zip(f["seq"], f["item"]))
        assert got == want
        asked.append(State.asked)
    assert asked[1] < len(acts) and asked[0] < 4 * len(acts)


def test_scansion_is_by_whole_texts_and_once(spark):
    from corvane.functions import script
    from corvane.plans import derived

    def plain(s):
        units = re.findall("[aiufxAIUFXeEoO][^aiufxAIUFXeEoO]*", re.sub("[^a-zA-Z~]", "", s))
        return "".join("G" if re.search("^[AIUFXeEoO]|[MH~]", u) or len(u) >= 3 else "L" for u in units)

    r = random.Random(5)
    texts = ["", "k", "a", "kk", "aM", "a kt", "a\n", "तa L0G1", *("".join(r.choices("aAiuekLGMH~'0 \nत", k=r.randint(0, 25))) for _ in range(500))]
    got = spark.createDataFrame([(x,) for x in [*texts, None]], "x string").select("x", script.scansion(F.col("x")).alias("w")).collect()
    assert all(g.w == (None if g.x is None else plain(g.x)) for g in got)
    lines = plan(derived.metres_of_lines(spark, "/root/testdata/sf0.001"))
    assert lines.count("regexp_replace") == 4 and "regexp_extract_all" not in lines and "[^a-zA-Z~]" not in lines


def test_a_decoder_keeps_what_does_not_depend_on_frames(monkeypatch):
    r = np.random.default_rng(7)
    fresh = lambda width: beam.Decoder(["", " ", "a", "b"], width=width, beta=0.3, hot=beam.Hotwords(["ab", "b"], 2.0))
    utterances = [np.log(r.dirichlet(np.ones(4), 4)) for _ in range(6)]
    utterances[3][1, 2] = -np.inf
    for width in (None, 5):
        kept = fresh(width)
        kept.decode(utterances[0])
        calls, extend = [], beam.Decoder.extend
        with monkeypatch.context() as m:
            m.setattr(beam.Decoder, "extend", lambda *a: calls.append(1) or extend(*a))
            again = kept.decode(utterances[0])
        assert not calls and again == fresh(width).decode(utterances[0])
        for held in (50_000, 0):
            with monkeypatch.context() as m:
                m.setattr(beam, "HELD", held)
                for u in utterances:
                    whole = kept.decode(u)
                    assert whole == fresh(width).decode(u) and kept.decode(u, 3) == whole[:3]


def test_grams_are_counted_before_they_are_shuffled(spark, monkeypatch):
    def plain(texts, order):
        out = {}
        for x in texts:
            if x:
                x = charlm.START + x.replace(" ", "|") + charlm.END
                for i in range(1, len(x)):
                    out[x[max(0, i - order + 1) : i + 1]] = out.get(x[max(0, i - order + 1) : i + 1], 0) + 1
        return out

    r = random.Random(9)
    texts = ["", None, "a", "ab ab", "é😀 aé", *("".join(r.choices("abc é😀", k=r.randint(1, 40))) for _ in range(50)), "".join(map(chr, range(0x4E00, 0x5800)))]
    for order in (1, 3, 6):
        got = charlm.gram_counts(spark.createDataFrame([(x,) for x in texts], "x string").repartition(3), "x", order).collect()
        assert {g.gram: g.n for g in got} == plain(texts, order) and len(got) == len(plain(texts, order))
        framed = [charlm.START + x.replace(" ", "|") + charlm.END for x in texts if x]
        codes, starts = np.frombuffer("".join(framed).encode("utf-32-le"), "<u4"), np.cumsum([0, *map(len, framed[:-1])])
        for window in (1, 7, 100):
            monkeypatch.setattr(charlm, "WINDOW", window)
            sums = {}
            for found, n in charlm._windows(codes[:2000], starts[starts < 2000], order) if window > 1 else charlm._windows(codes[:60], starts[starts < 60], order):
                for g, k in zip(found.to_pylist(), n.tolist()):
                    sums[g] = sums.get(g, 0) + k
            cut = "".join(framed)[: 2000 if window > 1 else 60]
            parts = [cut[a:b] for a, b in zip(starts, [*starts[1:], len(cut)]) if a < len(cut)]
            want = {}
            for x in parts:
                for i in range(1, len(x)):
                    want[x[max(0, i - order + 1) : i + 1]] = want.get(x[max(0, i - order + 1) : i + 1], 0) + 1
            assert sums == want
