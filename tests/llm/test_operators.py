"""Each operator against a brute-force version on the smallest tables, and on a table of awkward rows."""

import codecs
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import crf, imatch, langid, mixing, neardup, packing, quality, tokenfile, toxicity, urltree, warc
from corvane.llm.common import labelled_sample
from corvane.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


AWKWARD = [
    (0, None, None, None), (1, "", "en", "s"), (2, " \n\t ", "en", "s"), (3, "12 !! 34", "de", None), (4, "the cat sat on the mat and that was that " * 3000, "en", "s"),
    (5, "the same text here twice", "en", "s"), (5, "the same text here twice", "en", "s"), (6, "the same text here twice", "fr", "t"), (None, "the same text here twice", "en", "t"),
    (7, "a\x00b \u00a0 caf\u00e9 <|endoftext|> x", None, "\U0001F600"), (8, "one two three", "fr", "t"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, "kept", 1.5) for r in AWKWARD]
    # clashing names: columns that the operators make themselves
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string, size double").cache()


@pytest.fixture(scope="module")
def empty(spark, awkward):
    return awkward.limit(0)


def brute_marginals(emit, trans, start):
    n, k = emit.shape
    out, total = np.zeros((n, k)), 0.0
    for path in np.ndindex(*[k] * n):
        s = start[path[0]] + sum(emit[i, p] for i, p in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
        w = np.exp(s)
        total += w
        for i, p in enumerate(path):
            out[i, p] += w
    return out / total


def test_forward_backward_and_viterbi_match_enumeration():
    rng = np.random.default_rng(1)
    k, lens = 3, np.array([1, 5, 0, 3])
    emit, trans, start = rng.normal(size=(lens.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    gamma, pairs = crf.marginals(emit, lens, trans, start, pairs=True)
    best = crf.viterbi(emit, lens, trans, start)
    at = 0
    for n in lens[lens > 0]:
        e = emit[at : at + n]
        assert np.allclose(gamma[at : at + n], brute_marginals(e, trans, start), atol=1e-4)
        scores = {p: start[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in np.ndindex(*[k] * n)}
        assert tuple(best[at : at + n]) == max(scores, key=scores.get)
        at += n
    assert pairs.sum() == pytest.approx((lens[lens > 0] - 1).sum(), rel=1e-4)


def test_blocks_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    lens = np.array([200, 3, 77])
    emit, trans, start = rng.normal(size=(280, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    one, _ = crf.marginals(emit, lens, trans, start)
    monkeypatch.setattr(crf, "BLOCK", 500)
    two, _ = crf.marginals(emit, lens, trans, start)
    assert np.allclose(one, two, atol=1e-4)


def test_language_is_predicted_on_held_out_rows(spark, docs):
    rows = langid.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_languages_match_plain_forward_backward(spark, docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    model = langid.fit(docs.where(~F.col("doc_id").isin([r.doc_id for r in docs.collect() if held(r.doc_id)]) & F.col("lang").isNotNull()))
    got = {r.doc_id: r for r in langid.op1(docs).collect()}
    total = lambda x: max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
    k = len(model.langs)
    for r in docs.where("n_chars < 900").limit(25).collect():
        words = (r.text or "").encode().split()
        emit = langid._emissions(words, model).astype(float) if words else np.zeros((0, k))
        if not any(map(langid._has_letter, words)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        fore, back = [[emit[0][y] + model.start[y] for y in range(k)]], [[0.0] * k]
        for e in emit[1:]:
            fore.append([e[y] + total([fore[-1][a] + model.trans[a, y] for a in range(k)]) for y in range(k)])
        for e in emit[:0:-1]:
            back.append([total([model.trans[y, b] + e[b] + back[-1][b] for b in range(k)]) for y in range(k)])
        mass, n = [0.0] * k, 0
        for f, b, w in zip(fore, back[::-1], words):
            if langid._has_letter(w):
                mass, n = [m + math.exp(x + y - total(fore[-1])) for m, x, y in zip(mass, f, b)], n + 1
        best = max(range(k), key=lambda y: mass[y])
        assert got[r.doc_id].lang_pred == model.langs[best] and got[r.doc_id].score == pytest.approx(mass[best] / n, abs=1e-3)


def test_language_labels_switch_within_a_text(spark, docs):
    model = langid.fit(docs)
    texts = {r.lang: r.text for r in docs.where("length(text) > 300").collect()}
    a, b = texts["en"].split()[:40], texts["fr"].split()[:40]
    mixed = spark.createDataFrame([(1, " ".join(a + b))], "doc_id bigint, text string")
    row = langid.identify(mixed, model, spans=True).first()
    assert sum(s.n_words for s in row.lang_spans) == 80
    word = [s.lang for s in row.lang_spans for _ in range(s.n_words)]
    assert word[:40].count("en") >= 36 and word[40:].count("fr") >= 36


def test_language_awkward(spark, docs, awkward, empty):
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.identify(awkward, model).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[3].lang_pred == "und" and rows[0].score == 0.0
    assert rows[4].lang_pred == "en" and 0 <= rows[4].score <= 1
    assert langid.identify(awkward, model).columns == ["doc_id", "text", "lang", "source", "size", "lang_pred", "score"]
    assert langid.op1(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward, langid.train([])).collect()} == {"und"}


def test_packing_covers_every_document(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    rows = packing.op2(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
        assert sum(p.length for p in pieces) == len(ids[d]) and all(p.length == 1024 for p in pieces[1:])
        assert all(p.ids_crc32 == zlib.crc32(ids[d][p.start : p.start + p.length].tobytes()) for p in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
        assert sum(p.length for p in pieces) <= 1024
    bound = -(-sum(map(len, ids.values())) // 1024)
    assert len(by_sequence) <= bound * 1.02 + 3


def test_fullest_bin_is_exact():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 8))]
        room = rng.randint(0, 60)
        counts = np.bincount(lengths, minlength=61)
        found = packing.fullest(counts, room)
        sums = {sum(x for i, x in enumerate(lengths) if m >> i & 1) for m in range(1 << len(lengths))}
        assert all(counts[k] >= n for k, n in found.items())
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room)


def test_packing_awkward(spark, awkward, empty):
    rows = packing.op2(awkward, tokenizer_file("byte_bpe_50k.json")).collect()
    assert len([r for r in rows if r.doc_id == 5]) == 2 and [r.length for r in rows if r.doc_id == 0] == [1]
    assert max(r.piece for r in rows) > 10
    assert packing.op2(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


def brute_quality(text):
    b = (text or "").encode()
    words = WORD.findall(b)
    lines = b.split(b"\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), len(b"".join(words).decode()), sum(map((text or "").count, "#*$%&|<>")), dup, len(hit)


def test_quality_counts_match_brute_force(spark, docs, labels):
    texts = {r.doc_id: r.text for r in docs.where("length(text) < 4000").collect()}
    rows = quality.op3(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in texts:
            counts = brute_quality(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert not (r.base_failed and r.kept)


def test_quality_verdicts_match_plain_viterbi(spark, docs, labels):
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.op3(docs, labels).collect()}
    seen = Counter()
    for r in docs.collect():
        base, lines = quality.measure([(r.text or "").encode()])
        emit = lines.features @ model.weights
        best = [[(emit[0][y] + model.start[y], (y,)) for y in (0, 1)]] if len(emit) else []
        for e in emit[1:]:
            best.append([max(((s + model.trans[a, y] + e[y], (*path, y)) for a, (s, path) in enumerate(best[-1])), key=lambda x: x[0]) for y in (0, 1)])
        path = max(best[-1], key=lambda x: x[0])[1] if best else ()
        words, content = int(base["n_words"][0]), sum(int(w) for w, y in zip(lines.words, path) if y)
        kept = not got[r.doc_id].base_failed and content >= quality.KEEP_SHARE * max(words, 1)
        assert got[r.doc_id].kept == kept
        seen[kept] += 1
    assert min(seen.values()) > 5


def test_quality_labels_follow_training(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op3(d, l).join(l, "doc_id").where("not base_failed").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_quality_awkward(spark, docs, labels, awkward, empty):
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.judge(awkward, model, line_labels=True).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and rows[0].line_content == [] and not rows[4].kept
    assert quality.op3(empty, labels).count() == 0
    assert quality.op3(awkward, labels.limit(0)).count() == len(AWKWARD)


def brute_components(rows, width):
    sets = {}
    for d, text in rows:
        if d is None:
            continue
        words = [w.lower() for w in WORD.findall((text or "").encode())]
        sets[d] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [f"w{i}" for i in range(90)]
    for k in range(60):  # a chain of copies, each a little further from the first
        words = base[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "two words"), (20_003, "two words"), (20_004, "Two  WORDS")]
    got = {r.doc_id: r for r in neardup.op5(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_components(rows, 4)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_near_duplicates_without_pivots_are_compared_in_blocks(spark, monkeypatch):
    """With no pivot round every link must come from the comparison in blocks."""
    monkeypatch.setattr(neardup, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = [f"w{i}" for i in range(60)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in neardup.op5(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 4).items()}


def test_near_duplicates_of_rows_that_repeat_an_id_with_other_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, one), (1, two), (2, two + " more"), (3, one + " more"), (4, "something else of its own")]
    got = sorted((r.doc_id, r.component_id) for r in neardup.op5(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_near_duplicates_with_long_sets_and_many_columns_in_blocks(spark, monkeypatch):
    """Sets of more shingles than one step of the matrix product has columns."""
    rng = np.random.default_rng(3)
    left = [np.unique(rng.integers(0, 9000, 6000, dtype=np.uint64)) for _ in range(5)]
    right = [np.unique(np.concatenate([x[:4000], rng.integers(0, 9000, 500, dtype=np.uint64)])) for x in left] + [np.array([10**18], np.uint64)]
    assert neardup._overlaps(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_near_duplicates_ignore_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, text, 5, "a"), (2, text, 6, "b")], "doc_id bigint, text string, node int, component_id string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.op5(d.withColumns({c: F.lit(0) for c in ("h1", "h2", "bucket", "root", "kept", "n")})).collect()) == [(1, 1), (2, 1)]


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (5, 2), (3, 3)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and got[2] == 1 and got[5] == 1


def test_near_duplicates_awkward(spark, awkward, empty):
    rows = neardup.op5(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert neardup.op5(empty).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    files = tokenfile.write(docs, path, end_id=1, shard_tokens=20_000)
    rows = {r.doc_id: r for r in tokenfile.read(files, with_ids=True).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        want = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        got = rows[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes())) and bytes(got.ids) == want.tobytes()
        start += len(want)
    assert tokenfile.export(spark, files, str(tmp_path)) == files.count() > 1
    shard = tokenfile.TokenFile(sorted(tmp_path.iterdir())[0].read_bytes())
    whole = shard.tokens(0, shard.n_tokens)
    assert [shard.token(i) for i in range(0, shard.n_tokens, 97)] == whole[::97].tolist()
    assert shard.document(1).tolist() == whole[shard.starts[1] : shard.starts[2]].tolist()


def test_codes_of_any_width():
    rng = np.random.default_rng(6)
    ids = np.concatenate([rng.integers(0, 1 << b, 700, dtype=np.uint32) for b in (1, 8, 9, 16, 17, 24, 32)])
    rng.shuffle(ids)
    f = tokenfile.TokenFile(tokenfile.build([1, None], np.array([len(ids), 0]), ids))
    assert f.tokens(0, len(ids)).tolist() == ids.tolist() and [f.token(i) for i in range(len(ids))] == ids.tolist()
    assert all(f.tokens(a, b).tolist() == ids[a:b].tolist() for a, b in [(0, 1), (5, 5), (513, 1500), (3000, 4900)])
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_token_files_awkward(spark, awkward, empty):
    rows = tokenfile.op6(awkward, tokenizer_file("word_bpe_49k.json")).orderBy("start").collect()
    assert len(rows) == len(AWKWARD) and rows[0].doc_id is None and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert tokenfile.op6(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_toxicity_on_held_out_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op7(d, l).join(l, "doc_id").where("held_out").collect()
    bad, good = ([r for r in rows if r.toxic == x] for x in (1, 0))
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad) and sum(r.predicted for r in good) <= 0.02 * len(good)


def test_toxicity_scores_match_plain_loops(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    model = toxicity.fit(docs, labels.where(F.col("doc_id").isin([r.doc_id for r in labels.collect() if not held(r.doc_id)])))
    got = {r.doc_id: r for r in toxicity.op7(docs, labels).collect()}
    assert all(r.held_out == held(d) for d, r in got.items())
    for r in docs.where("n_chars < 1500").limit(25).collect():
        codes = [ord(c) for c in " " + re.sub(r"[\t\n\v\f\r]", " ", r.text).translate({i: i + 32 for i in range(65, 91)}) + " "]
        counts = Counter()
        for n in toxicity.ORDERS:
            for i in range(len(codes) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 + codes[i + k] + k + 1) & 0xFFFFFFFF
                counts[((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - toxicity.BITS] += 1
        z = model.bias + sum(float(model.weights[b]) * math.log2(1 + c) for b, c in counts.items())
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_toxicity_awkward(spark, docs, labels, awkward, empty):
    rows = toxicity.score(awkward, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.op7(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.op7(awkward, labels.limit(0)).collect()} <= {0, 1}


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def brute_draw(doc_id, text):
    """A document's exponential key: its digest's draw over its quality weight."""
    unit = (int(hashlib.md5(f"{'' if doc_id is None else doc_id}:mix".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
    size, symbols = len(WORD.findall(text.encode())), sum(c in "#*$%&|<>{}[]!" for c in text)
    return -math.log(unit) * (size + 1 + symbols) / (size + 1)


def test_mixing_reaches_targets(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a"] * 60 + ["b", "c", None, "\U0001F600", "z"])) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken in {k * r.size for k in range(4)}
    want = brute_targets(sizes)
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes) and all(r.source_size == sizes[r.source] for r in out)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string")).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_mixing_awkward(spark, awkward, empty):
    rows = mixing.op8(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.op8(empty).count() == 0
    assert mixing.op8(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")).first().taken == 0


def brute_url(url):
    rest = url.partition("://")[2] if url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fit = [r for r in urltree.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_urls_match_brute_force(spark):
    odd = [None, "", "no scheme/x", "http://A.NET/x?y", "http://net", "x://y://example.com/de/1", "https://EXAMPLE.com/de/", "http://example.com?a/b", "http://h#f", "://", "http://a.org/fr/\n"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(list(enumerate(odd, 10**6)), "page_id bigint, url string"))
    urls = {r.page_id: r.url for r in pages.collect()}
    rows = urltree.op4(pages).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_verdicts_do_not_depend_on_how_many_sections_a_host_has(spark):
    rules = (urltree.Rule("x.test/de/", "block"),)
    for sections in (23, 30):
        names = ["de", *(f"s{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(sections - 1))]
        urls = [f"http://x.test/{s}/{i}" for s in names for i in range(100)] + [f"http://x.test/only-{w}" for w in ("one", "two", "three")]
        rows = urltree.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
        assert {(r.path.split("/")[1], r.verdict) for r in rows if r.verdict == "block"} == {("de", "block")}
        assert {r.template for r in rows} == {"/?", *(f"/{s}/*" for s in names)}


def test_templates_follow_the_deepest_path(spark):
    deep = "/a/b/c/d/e/f/g/h"
    rules = (urltree.Rule(f"x.test{deep}/bad/1", "block"),)
    urls = [f"http://x.test{deep}/{s}/{i}" for s in ("bad", "fine") for i in range(100, 250)]
    rows = urltree.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).where("rule is null").collect()
    assert {(r.template, r.verdict) for r in rows} == {(f"{deep}/bad/*", "block"), (f"{deep}/fine/*", "allow")}


def test_templates_carry_labels_to_their_other_urls(spark):
    rules = (urltree.Rule("bad.test/ads/1", "block"), urltree.Rule("good.test/news/1", "allow"))
    urls = [f"http://{h}/{s}/{i}" for h, s in (("bad.test", "ads"), ("bad.test", "blog"), ("good.test", "news")) for i in range(100, 200)]
    urls += [f"http://{h}/{s}/2{i}" for h, s in (("bad.test", "ads"), ("good.test", "news")) for i in range(50)]
    rows = urltree.judge(spark.createDataFrame([(u,) for u in urls], "url string").withColumn("host", F.lit(1)), rules).where("rule is null").collect()
    verdicts = {(r.host, r.template, r.verdict) for r in rows}
    assert verdicts == {("bad.test", "/ads/*", "block"), ("bad.test", "/blog/*", "allow"), ("good.test", "/news/*", "allow")}
    assert urltree.judge(spark.createDataFrame([], "url string")).count() == 0


def plain_judge(urls, rules, reject=0.9):
    """(template, purity, verdict) of each url by plain dictionaries."""
    parsed = []
    for u in urls:
        host, path = "", ""
        if u and "://" in u:
            rest = u[u.index("://") + 3 :]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate({i: i + 32 for i in range(65, 91)})
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        parsed.append((host, path, max(fits, key=lambda r: len(r.text)).verdict if fits else None))
    seg = lambda path: [re.sub("[0-9]+", "*", s) for s in path.split("/") if s]
    out = {}
    for host in {h for h, *_ in parsed}:
        own = [(seg(p), p, v) for h, p, v in parsed if h == host]

        def branches(rows, depth):
            found = {}
            for r in rows:
                if len(r[0]) > depth:
                    found.setdefault(r[0][depth], []).append(r)
            return found

        def labels(rows):
            return sum(v == "block" for *_, v in rows), sum(v is not None for *_, v in rows)

        def profile(rows, depth):
            """Paths by class of the branch's children; depth: that of the children."""
            n = Counter()
            for s, rs in branches(rows, depth).items():
                paths = {p for _, p, _ in rs}
                n["?" if len(paths) == 1 and not labels(rs)[1] else s] += len(paths)
            if ends := {p for x, p, _ in rows if len(x) == depth}:
                n["/"] = len(ends)
            return n

        def alike(a, b):
            n, p, classes = sum(a.values()), sum(b.values()), set(a) | set(b)
            chi = sum((math.sqrt(p / n) * a[c] - math.sqrt(n / p) * b[c]) ** 2 / (a[c] + b[c]) for c in classes)
            k = len(classes) - 1
            return chi <= k + 2.33 * math.sqrt(2 * k) + 1e-9

        def grow(rows, template, depth, q):
            for x, p, v in rows:
                if len(x) == depth:
                    t = out.setdefault((host, (template,)), [0, 0, q])
                    t[0] += v == "block"
                    t[1] += v is not None
                    t[2] = max(t[2], q)
                    out[host, p] = template
            found = branches(rows, depth)
            known = {s: labels(rs) for s, rs in found.items() if labels(rs)[1]}
            weigh = lambda s: known[s][1] / (known[s][1] + 2)
            for s, rs in found.items():
                b, n = labels(rs)
                if n:
                    like = [x for x in known if x != s]
                    rest_b, rest_n = sum(known[x][0] for x in like), sum(known[x][1] for x in like)
                    merged = False
                    if n >= 5 and rest_n >= 5:
                        share = (b + rest_b) / (n + rest_n)
                        merged = abs(b / n - rest_b / rest_n) <= 1.64 * math.sqrt(share * (1 - share) * (1 / n + 1 / rest_n))
                else:
                    like = []
                    for bad in (True, False):
                        kin = [x for x in known if (known[x][0] / known[x][1] >= 0.5) == bad]
                        if kin and alike(profile(rs, depth + 1), sum((profile(found[x], depth + 1) for x in kin), Counter())):
                            like += kin
                    merged = len(like) >= 10
                step = "?+" if merged else "?" if not n and len({p for _, p, _ in rs}) == 1 else s
                a, w = sum(weigh(x) * known[x][0] / known[x][1] for x in like), sum(map(weigh, like))
                grow(rs, f"{template}/{step}", depth + 1, (a + 2 * q) / (w + 2))

        grow(own, "", 0, 0.5)
    result = []
    for host, path, verdict in parsed:
        template = out[host, path]
        bad, n, q = out[host, (template,)]
        purity = (bad + 2 * q) / (n + 2)
        result.append((template, purity, verdict or ("block" if purity >= reject else "allow")))
    return result


@pytest.mark.parametrize("few", [100_000, 3])
def test_verdicts_match_a_plain_tree(spark, monkeypatch, few):
    monkeypatch.setattr(urltree, "BROADCAST_SHAPES", few)
    monkeypatch.setattr(urltree, "ONE_TASK_SHAPES", 0 if few == 3 else 10_000)
    rng = random.Random(9)
    rules = (urltree.Rule("a.test/x/", "block"), urltree.Rule("a.test/x/ok/", "allow"), urltree.Rule("b.test/", "block"), urltree.Rule("b.test/n/", "allow"), urltree.Rule("c.test/x/y/1", "block"))
    urls = [f"http://{rng.choice('abc')}.test/" + "/".join(rng.choice(["x", "y", "ok", "n", str(rng.randint(1, 30)), f"slug-{rng.randint(1, 9)}"]) for _ in range(rng.randint(0, 4))) for _ in range(400)]
    urls += [f"http://bad.a.test/x/{i}" for i in range(95)] + ["http://bad.a.test/about", "http://bad.a.test/news/1", "http://bad.a.test/news/2"]
    urls += [None, "", "no scheme", "http://", "HTTP://A.TEST/x/1?q", "http://a.test//x//1#f"] + ["http://c.test/x/y/12"] * 20 + ["http://c.test/x/y/22"] * 3
    got = urltree.judge(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), rules).orderBy("i").collect()
    want = plain_judge(urls, rules)
    assert len(got) == len(urls)
    for r, (template, purity, verdict) in zip(got, want, strict=True):
        assert (r.template, r.verdict) == (template, verdict), r
        assert r.purity is None if r.rule else r.purity == pytest.approx(purity)
    by = {r.url: r for r in got}
    # one blocked section decides nothing of the others; a template's own labels decide its other urls
    assert by["http://bad.a.test/about"].rule is None and by["http://bad.a.test/about"].verdict == "allow" and by["http://c.test/x/y/22"].verdict == "block"


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_an_unlabelled_branch_among_blocked_ones_of_its_look(spark, depth):
    deep = "/".join(f"level-{chr(97 + i)}" for i in range(depth))
    names = [chr(97 + i) * 3 for i in range(12)]
    for others, shape, verdict in (("blocked", "{}/item-{}", "block"), ("blocked", "{}/more/x{}y/z", "allow"), ("few", "{}/item-{}", "allow"), ("mixed", "{}/item-{}", "allow")):
        base = "http://x.test/" + (deep + "/" if deep else "")
        ruled = names[:4] if others == "few" else names
        rules = tuple(urltree.Rule(f"x.test/{deep + '/' if deep else ''}{s}/", "allow" if others == "mixed" and i % 2 else "block") for i, s in enumerate(ruled))
        urls = [f"{base}{s}/item-{i}" for s in names for i in range(8)] + [base + shape.format("new", i) for i in range(8)]
        rows = urltree.judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).where("url like '%/new/%'").collect()
        assert {r.verdict for r in rows} == {verdict} and len(rows) == 8, (others, shape)
        assert [(r.template, r.verdict) for r in rows] == [x[::2] for x in plain_judge(urls, rules)[-8:]]


def test_paths_of_hundreds_of_segments(spark):
    urls = ["http://x.test/" + "/".join(f"s{i % 7}" for i in range(400)) + f"/{k}" for k in (1, 2)] + ["http://x.test" + "/a" * 300]
    rows = urltree.judge(spark.createDataFrame([(u,) for u in urls], "url string"), (urltree.Rule("x.test/s0/", "block"),)).collect()
    assert [r.verdict for r in rows] == ["block", "block", "allow"] and rows[2].template == "/?" * 300


def test_the_drivers_pages_match_a_plain_tree(spark):
    rows = urltree.op4(spark.read.parquet(f"{SF}/pages.parquet")).orderBy("page_id").collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    assert [(r.template, r.verdict) for r in rows] == [(t, v) for t, _, v in plain_judge([p.url for p in pages], urltree.RULES)]


class _Text(HTMLParser):
    """Visible text by the standard library's parser: what the scanner is held against."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.out.clear()
        self.out += ["\n"] * (tag in warc._BREAKS)
        self.hidden += tag in warc._HIDDEN
        if tag in warc._LINKING:
            self.links += [v for k, v in attrs if k in ("href", "src")]

    def handle_endtag(self, tag):
        self.out += ["\n"] * (tag in warc._BREAKS)
        self.hidden -= tag in warc._HIDDEN

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_page_text_matches_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(pages) > 20
    squeeze = lambda x: " ".join(x.split())
    for r in pages:
        other = _Text()
        other.feed(r.html)
        other.close()
        got = warc.Page(r.html)
        assert squeeze(got.text) == squeeze("".join(other.out)), r.page_id
        assert [x["url"] for x in got.links] == other.links


@pytest.mark.parametrize("mark", ["<a href ", "<!--", "<title>", "<script>", "<a ", '<a x="', "<a x='>", "</", '<a href=" ', "x < y ", "&#" + "9" * 5000 + ";", "a = b "])
def test_a_megabyte_of_any_markup_takes_no_time(mark):
    start = time.perf_counter()
    warc.Page(mark * (1_000_000 // len(mark)))
    assert time.perf_counter() - start < 1


def test_page_parts():
    page = warc.Page("<head><title>T &amp; x</title><script src='s.js'>var a='<b>';</script></head><BODY class='a>b'>Hi<br>there <b>bold</b> &lt;x&gt; <!-- no --> <a HREF='u?a=1&amp;b'>link</a> 3 < 4<style>p{}</style><p>End &#00000000065;&#99999999999;</body> tail")
    assert page.title == "T & x" and page.text == "Hi\nthere bold <x> link 3 < 4\nEnd A\ufffd"
    assert page.links == [{"path": "SCRIPT@/src", "url": "s.js"}, {"path": "A@/href", "url": "u?a=1&b"}]
    assert warc.Page("<p>a<script>b").text == "a" and warc.Page("a<!-- b").text == "a" and warc.Page("a<b c").text == "a" and warc.Page("").text == ""


def _stored(http: bytes, *headers, kind="response") -> bytes:
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", "<urn:x>"), ("warc-target-uri", "http://x/"), *headers], http)


def test_derivatives_keep_all_headers_and_decode_bodies(spark):
    plain = "<p>caf\u00e9</p>"
    zipped = zlib.compressobj(wbits=31)
    body = zipped.compress(plain.encode()) + zipped.flush()
    chunks = b"".join(b"%x;e=1\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    good = [
        b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie:b\r\n folded\r\ncontent-type: text/html; charset=iso-8859-1\r\n\r\n" + plain.encode("latin-1"),
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks,
        b"HTTP/1.1 200 OK\r\n\r\n" + b'<meta charset="windows-1252">' + plain.encode("cp1252"),
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such\r\n\r\n" + plain.encode(),
        b"HTTP/1.1 200 OK\r\n\r\n" + codecs.BOM_UTF16_LE + plain.encode("utf-16-le"),
    ]
    bad = [None, b"", b"junk", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", _stored(b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\nx"), _stored(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz")]
    rows = [(i, _stored(x, ("X-Note", "1"), ("X-Note", "2"))) for i, x in enumerate(good)] + [(100 + i, x) for i, x in enumerate(bad)] + [(200, _stored(b"software: x", kind="warcinfo"))]
    got = warc.derive(spark.createDataFrame(rows, "page_id bigint, warc binary")).collect()
    by = {(r.page_id, r.record_type): r for r in got}
    assert all(bytes(by[i, "conversion"].block).decode().strip("\ufeff") == "caf\u00e9" for i in range(len(good)))
    meta = json.loads(bytes(by[0, "metadata"].block))["Envelope"]
    assert meta["HTTP-Response-Metadata"]["Headers"][:2] == [["Set-Cookie", "a"], ["Set-Cookie", "b folded"]]
    assert [x for x in meta["WARC-Header-Metadata"] if x[0] == "X-Note"] == [["X-Note", "1"], ["X-Note", "2"]]
    assert by[0, "conversion"].target_uri == "http://x/"
    assert sorted(r.page_id for r in got if r.error) == [100 + i for i in range(len(bad))] and 200 not in {r.page_id for r in got}


def test_derivatives_link_back_to_responses(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").union(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "http://x/\r\ny", "<p>a&amp;b<script>no</script><br>c")], "page_id bigint, url string, html string"))
    named = lambda data: (lambda h, block: (dict(h), block))(*warc.parse(bytes(data)))
    source = {r.page_id: named(r.warc) for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages).withColumn("block", F.lit("clash")).withColumn("error", F.lit(1))).collect()
    assert len(rows) == 2 * pages.count() and all(r.error is None for r in rows)
    for r in rows:
        headers, block = named(r.warc)
        origin, http = source[r.page_id]
        body = http.partition(b"\r\n\r\n")[2]
        assert r.refers_to == headers["WARC-Refers-To"] == origin["WARC-Record-ID"] and headers["WARC-Target-URI"] == origin["WARC-Target-URI"]
        assert headers["WARC-Block-Digest"] == warc.digest(block) and r.source_payload_digest == warc.digest(body) and block == bytes(r.block)
        if r.record_type == "metadata":
            assert json.loads(block)["Envelope"]["Payload-Digest"] == warc.digest(body)
    text = next(bytes(r.block) for r in rows if r.page_id == 10**6 + 1 and r.record_type == "conversion")
    assert text == b"a&b\nc"
    assert len({r.record_id for r in rows}) == len(rows)
    assert warc.op9(pages.limit(0)).count() == 0


def brute_imatch(texts, terms):
    """The fingerprint by plain loops over Python integers."""
    import xxhash

    mask, lex, out = (1 << 64) - 1, sorted(int(t) for t in terms), []
    place = {t: i for i, t in enumerate(lex)}
    mix = lambda x: int(imatch.mix64(np.array([x], np.uint64))[0])
    for text in texts:
        own = sorted({xxhash.xxh64_intdigest(w.lower()) for w in WORD.findall(text.encode())} & place.keys())
        row = []
        for seed, limit in zip(imatch._SEEDS, imatch._LIMITS):
            chosen = [t for t in own if mix(t ^ int(seed)) >> 32 < int(limit)]
            total = sum(mix(t) * pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i, t in enumerate(chosen)) & mask
            row.append(max(mix(total) >> 48, 1) if chosen else 0)
        every = {xxhash.xxh64_intdigest(w.lower()) for w in WORD.findall(text.encode())}
        if every and not any(row):
            row[0] = max(mix(sum(map(mix, every)) & mask) >> 48, 1)
        out.append("".join(f"{x:04x}" for x in row))
    return out


def test_fingerprints_match_brute_force(spark, docs):
    rows = {r.doc_id: r for r in imatch.op10(docs).collect()}
    plain = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    terms = imatch.lexicon(docs)
    counts = {}
    for _, text in plain:
        for w in {w.lower() for w in WORD.findall(text.encode())}:
            counts[w] = counts.get(w, 0) + 1
    import xxhash

    n = len(plain)
    assert set(terms.tolist()) == {xxhash.xxh64_intdigest(w) for w, c in counts.items() if imatch.LEAST_SHARE * n <= c <= imatch.MOST_SHARE * n}
    for i in range(0, n, 20):
        (d, text), (_, after) = plain[i], plain[(i + 1) % n]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, other, nxt = brute_imatch([text, changed, after], terms)
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        halves = lambda s: [s[k : k + 4] for k in range(0, len(s), 4)]
        either = [(a, b) for a, b in zip(halves(own), halves(nxt)) if a != "0000" or b != "0000"]
        assert r.near_next == pytest.approx(sum(a == b for a, b in either) / len(either) if either else 1.0)
    assert np.mean([r.near_edited for r in rows.values()]) > 10 * np.mean([r.near_next for r in rows.values()])


def test_next_documents_across_runs(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RUN_ROWS", 3)
    d = spark.createDataFrame([(i * 7, f"text {i} " * (i % 5 + 1)) for i in range(40)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in imatch.op10(d).collect()}
    texts = [f"text {i} " * (i % 5 + 1) for i in range(40)]
    assert len(rows) == 40
    for i, t in enumerate(texts):
        assert rows[i * 7].edited_sha256 == hashlib.sha256(imatch.edited(t, texts[(i + 1) % 40]).encode()).hexdigest()


def test_fingerprints_awkward(spark, awkward, empty):
    rows = imatch.op10(awkward).collect()
    assert len(rows) == len(AWKWARD) and len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert imatch.op10(empty).count() == 0
    # texts without a term of the lexicon are told apart, but for those of equal terms
    short = imatch.Fingerprinter(np.zeros(0, np.uint64))([b"one two", b"three", b"two One", b"", None])
    assert (short[0] == short[2]).all() and (short[0] != short[1]).any() and not short[3:].any()
    alone = imatch.op10(spark.createDataFrame([(1, "just one")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"just" + b"just").hexdigest()


def test_texts_too_long_to_learn_from_are_still_judged(spark):
    """Fits leave out texts above LONGEST_SAMPLED characters; every text is read whole by what they fit."""
    long = "zeta omega " * 20_000
    rows = [(i, f"alpha beta gamma {i}", "en") for i in range(1, 80)] + [(i, f"eins zwei drei {i}", "de") for i in range(100, 180)] + [(999, long, "xx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = langid.identify(df, langid.fit(df))
    assert {r.lang_pred for r in known.collect()} == {"en", "de"}  # nothing of xx was learned
    marks = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    found, counts = labelled_sample(df, marks, "toxic", "text", "doc_id", 500)
    assert 999 not in {r[0] for r in found} and len(found) == 159 and sum(counts.values()) == 160
    scored = toxicity.score(df, toxicity.fit(df, marks)).where("doc_id = 999").first()
    assert 0 <= scored.score <= 1
    judged = quality.op3(df, marks).where("doc_id = 999").first()
    assert judged.n_words == 40_000 and judged.base_failed


def test_fingerprints_of_many_null_ids(spark):
    rows = [(None, f"text number {i} of some words") for i in range(2500)] + [(i, f"other {i} text") for i in range(20)]
    got = imatch.op10(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 2520 and sum(r.doc_id is None for r in got) == 2500 and all(0 <= r.near_next <= 1 for r in got)


def test_byte_level_words_are_encoded_as_the_library_does():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from corvane.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(4)
    odd = ["a", "é", "à", "í", "÷", "don't", "'s", ".", ",", " ", "\n", "!", "1", "X", "<|", "‘", "Б", "&", "\x01"]
    texts = ["".join(r.choices(odd, k=r.randint(0, 14))) for _ in range(2000)]
    texts += [" ".join("".join(r.choices(["a", "é", "à", "ing", ".", ",", "!", "1"], weights=[9, 2, 2, 9, 1, 1, 0.3, 0.3], k=r.randint(1, 5))) for _ in range(r.randint(1, 6))) for _ in range(2000)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    enc = tokens.Encoder(path, True)
    ids, counts = enc.encode([x.encode() for x in texts])
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    # stops leave no chunks of their own, and words go without their white space
    enc = tokens.Encoder(path, True)
    enc.encode([b"a word, word. word"] * 3)
    assert set(enc.cache.ids) == {b"\0a", b"word", b"\0,", b"\0."}
    ids, counts = enc._words([tokens._WORD(b"word"), tokens._WORD("à,!".encode())])
    assert ids.tolist() == enc.tok.encode(" word à,!", add_special_tokens=False).ids and counts[0] == 1
