"""Exact duplicates by tries, periodic runs and importance resampling, held against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import importance, runs, trie

DOCS = "doc_id bigint, text string, lang string, digest string, body string, place int, block int, name string, start int, rows int, score double"


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "d", "b", 1, 2, "n", 3, 4, 0.5) for i, t in rows], DOCS)


# ------------------------------------------------------------------ exact duplicates


def plain_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        body = "".join(c for c in t or "" if c not in " \t\n\v\f\r")
        groups[body].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, digest) for k, m in enumerate(members)]
    return Counter(out)


ROWS = [
    (5, "a b c"), (3, "abc"), (9, "a  bc "), (2, "ab c "), (7, None), (8, ""), (1, " \n\t"), (11, "xabc"), (None, "abc"), (None, "null id"), (None, "null id"), (12, "ä b"), (13, "äb "), (14, "äb "),
    (20, "same row"), (20, "same row"), (20, "same row"), (21, "abcd"), (22, "abce"), (23, "x" * 70_000 + "y"), (24, "x" * 70_000 + "z"), (25, "x " * 70_000 + "y"),
]


@pytest.mark.parametrize("budget", [1, 2000, trie.TRIE_BYTES])
def test_exact_dedup_equals_plain_groups(spark, budget):
    got = trie.assign(frame(spark, ROWS), budget=budget).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got) == plain_classes(ROWS)


@pytest.mark.parametrize("digest", [lambda body: b"", lambda body: body[:1].rjust(1, b"-")])
def test_different_texts_of_one_digest_stay_apart(spark, digest):
    want = Counter((a, b, c, d) for a, b, c, d, _ in plain_classes(ROWS).elements())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in trie.assign(frame(spark, ROWS), digest=digest, budget=500).collect()) == want


def test_exact_dedup_of_an_empty_table(spark):
    assert trie.op11(frame(spark, [])).collect() == []


def test_radix_trie_holds_what_a_dict_holds():
    rnd = random.Random(3)
    t, want = trie.RadixTrie(), {}
    given = []
    for i in range(3000):
        key = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9)))
        if key:
            t.insert(key, [-len(key), False, i, 1, 1])
            want[key] = want.get(key, 0) + 1
        if rnd.random() < 0.01:
            given += t.spill_heaviest(max(0, t.held // 2))
    given += t.drain()
    counts = Counter()
    for key, owner in given:
        counts[key] += owner[3]
    assert counts == want and t.held == 0


def test_complete_subtrees_leave_and_the_open_one_stays():
    t = trie.RadixTrie()
    for key in (b"aaa1", b"aaa2", b"aab1", b"abb", b"b"):
        t.insert(key, [0, False, 1, 1, 1])
    assert [k for k, _ in t.spill_complete(b"aab")] == [b"b", b"abb", b"aaa1", b"aaa2"]
    assert [k for k, _ in t.drain()] == [b"aab1"]


# ------------------------------------------------------------------ periodic runs


def plain_runs(words, least=24, exponent=3):
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, length = i, j + q - i
            x = words[s : s + length]
            if length >= max(least, exponent * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.append((s, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_runs_equal_all_pairs_of_places():
    rnd = random.Random(5)
    for _ in range(150):
        many = []
        for _ in range(rnd.randint(1, 4)):
            k, n = rnd.choice([1, 2, 2, 3, 5, 50]), rnd.choice([0, 1, 5, 30, 60, 90])
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 4))
                w = w[:a] + [w[a:][i % min(p, n - a)] for i in range(n - a)]
            many.append(w + w[: n // 2] + w if rnd.random() < 0.3 else w)
        sizes = np.array([len(w) for w in many])
        ids = np.array([x for w in many for x in w], np.int64)
        starts = np.cumsum(sizes) - sizes
        for least, exponent in ((24, 3), (4, 2), (9, 4)):
            found = runs.runs(ids, np.repeat(np.arange(len(many)), sizes), least, exponent, at_once=7)
            for d, w in enumerate(many):
                got = [(s - starts[d], length, q) for x, s, length, q in found.tolist() if x == d]
                assert got == plain_runs(w, least, exponent)


def test_periodic_runs_query_equals_a_plain_one(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abc") * rnd.choice([1, 2]) for _ in range(rnd.choice([0, 3, 40, 90])))) for i in range(60)]
    rows += [(100, "ab cd " * 30 + "end"), (101, "go " * 200), (102, None), (103, ""), (103, "x y\tz " * 9), (103, "x y\tz " * 9), (104, "p q r s " * 5 + "t u " * 20 + "v w " * 20)]
    rows += [(200 + i, " ".join(f"w{k}" for k in range(80))) for i in range(60)]
    got = Counter(tuple(r) for r in runs.op12(frame(spark, rows)).collect())
    assert got == Counter(plain_digest(i, t) for i, t in rows)
    assert any(r[1] > 1 for r in got) and any(r[0] >= 200 and r[1] for r in got)
    assert runs.op12(frame(spark, [(None, "a " * 30)])).first().n_runs == 1 and runs.op12(frame(spark, [])).collect() == []
    listed = runs.find(frame(spark, [(1, "a b " * 20), (2, "c")])).collect()
    assert [tuple(r) for r in listed] == [(1, 0, 40, 2)]


# ------------------------------------------------------------------ importance resampling


def plain_features(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in folded).split(" ")
    words = [w for w in words if w]
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resampling(docs, target, buckets=10_000, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    aim = Counter(bucket(f) for t in target for f in plain_features(t)[1])
    all_s, all_t = sum(s.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, t in docs:
        words, features = plain_features(t)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        name = str(i) if i is not None else "text:" + hashlib.md5((t or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks[r].append(k)
    return Counter((r[0], r[2], r[3], r[4], ranks[r].pop(0) if ranks[r] else None) for r in rows)


def test_resampling_equals_plain_counts(spark):
    rnd = random.Random(2)
    vocabulary = ["one", "Two", "thrée", "four4", "V", "sechs-seben", "日本語", "x" * 90, "y" * 64, "z" * 63, "ÄÖ"]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 19, 20, 60])))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, ".,;"), (None, "one two " * 15), (None, "one two " * 15), (403, "four4 v " * 12), (403, "four4 v " * 12), (403, "four4 v " * 12), (404, "one " * 30_000)]
    target = spark.createDataFrame([("one two three", 1), (None, 2), ("sechs seben V", 3)], "text string, item_id int")
    got = importance.draw(importance.weigh(frame(spark, rows), target)).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == plain_resampling(rows, ["one two three", None, "sechs seben V"])


def test_resampling_does_not_depend_on_ranges_and_salts(spark, monkeypatch):
    rows = [(i, f"word{i % 7} other{i % 5} " * (i % 30)) for i in range(2500)]
    target = spark.createDataFrame([("word1 other2 word1",)], "text string")
    want = plain_resampling(rows, ["word1 other2 word1"], buckets=100)
    monkeypatch.setattr(importance, "BLOCKS_A_SALT", 1)
    weighed = importance.weigh(frame(spark, rows).repartition(6), target, buckets=100, ranges=7)
    got = importance.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(tuple(r) for r in got.collect()) == want


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.op13(frame(spark, []), none).collect() == []
    rows = [(i, "alpha beta gamma delta " * 6) for i in range(9)]
    assert Counter(tuple(r) for r in importance.op13(frame(spark, rows), none).collect()) == plain_resampling(rows, [])


def test_checksums_of_pairs_are_those_of_the_joined_words():
    words = [b"a", b"bc", "é日".encode(), b"q" * 62, b"q" * 63, b"r" * 64, b"s" * 65, b"t" * 5000]
    text = b" ".join(a + b" " + b for a in words for b in words)
    got = importance.Features(1 << 32).of([text])[1].tolist()
    flat = text.split()
    assert got == [zlib.crc32(w) for w in flat] + [zlib.crc32(a + b" " + b) for a, b in zip(flat, flat[1:])]
