"""The pipeline against its stages taken one by one."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import langid, toxicity
from corvane.llm.queries import tokenizer_file

from test_operators import brute_components, brute_draw, brute_targets

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "near_dedup", "mixing", "packing"]
    known = stages["language_id"](spark, docs, SF).cache()
    assert known.columns == corpus_pipeline.COLUMNS
    model = langid.fit(docs)
    want = {r.doc_id for r in langid.identify(docs, model, certainty=True).collect() if r.lang_pred != "und" and r.certainty >= 0.5}
    assert {r.doc_id for r in known.collect()} == want and len(want) >= 0.98 * docs.count()
    clean = stages["toxicity"](spark, known, SF).cache()
    scores = toxicity.score(known, toxicity.fit(known, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in scores if not r.predicted}
    unique = stages["near_dedup"](spark, clean, SF).cache()
    roots = brute_components([(r.doc_id, r.text) for r in clean.collect()], 5)
    assert {r.doc_id for r in unique.collect()} == {d for d, (_, root) in roots.items() if root == d}
    mixed = stages["mixing"](spark, unique, SF).cache()
    sizes, taken = {}, {}
    longest = 0
    for r in unique.collect():
        n = len(r.text.encode().split())
        sizes[r.source], longest = sizes.get(r.source, 0) + n, max(longest, n)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in brute_targets(sizes).items())
    packed = stages["packing"](spark, mixed, SF).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()
    assert max(np.bincount([r.sequence_id for r in packed], [r.length for r in packed])) <= 1024


COLUMNS = {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_run_matches_brute_force(spark):
    """All stages after one another, by plain Python from the models of the fitted ones."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r for r in docs.collect()}
    named = langid.identify(docs, langid.fit(docs), certainty=True).collect()
    left = {r.doc_id for r in named if r.lang_pred != "und" and r.certainty >= 0.5}
    known = docs.where(F.col("doc_id").isin(list(left)))
    scored = toxicity.score(known, toxicity.fit(known, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    left = {r.doc_id for r in scored if not r.predicted}
    roots = brute_components([(d, text[d].text) for d in left], 5)
    left = {d for d, (_, root) in roots.items() if root == d}
    words = {d: len(text[d].text.encode().split()) for d in left}
    sizes = {}
    for d in left:
        sizes[text[d].source] = sizes.get(text[d].source, 0) + words[d]
    targets, times = brute_targets(sizes), {}
    for source, target in targets.items():
        own = sorted((brute_draw(d, text[d].text), d) for d in left if text[d].source == source)
        full, before = (int(target // sizes[source]) if sizes[source] else 0), 0
        for _, d in own:
            more = 2 * before + words[d] <= 2 * (target - full * sizes[source])
            before += words[d]
            times[d] = min(full + more, 3)
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for d, n in times.items():
        ids = np.array([*tok.encode(text[d].text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    rows = corpus_pipeline.run(spark, SF).collect()
    assert set(rows[0].asDict()) == COLUMNS
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == +want
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in placed.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= 1024


def test_awkward_and_empty_tables(spark, tmp_path):
    from test_operators import AWKWARD

    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("doc_id", F.col("doc_id") + 1000)
    odd = spark.createDataFrame([(*r, len(r[1] or ""), 7, "x") for r in AWKWARD], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, _row string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, docs in (("odd", odd.unionByName(real, allowMissingColumns=True)), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}/odd")
    assert set(rows.columns) == COLUMNS
    ids = {r.doc_id for r in rows.collect()}
    assert len(ids) > 20 and not ids & {0, 1, 2, 3, 6}  # no language, and a copy of 5
    assert set(corpus_pipeline.run(spark, f"file://{tmp_path}/empty").columns) == COLUMNS and corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0


def test_null_ids_and_repeated_rows(spark):
    stages = dict(corpus_pipeline.STAGES)
    say = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    texts = [(None, say("a")), (None, say("b")), (None, say("b")), (7, say("c")), (7, say("c")), (7, say("c")), (None, say("c")), (5, say("d")), (9, say("d") + " end"), (3, say("e")), (3, say("f"))]
    texts += [(None, None), (None, None), (4, " "), (4, " "), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    order = lambda rows: sorted(rows, key=str)
    unique = stages["near_dedup"](spark, docs, SF)
    want = [(None, say("a")), (None, say("b")), (7, say("c")), (5, say("d")), (3, say("e")), (3, say("f")), (None, None), (4, " "), (6, " ")]
    assert unique.columns == corpus_pipeline.COLUMNS
    assert order((r.doc_id, r.text) for r in unique.collect()) == order(want)
    mixed = stages["mixing"](spark, unique, SF)
    # one source has its own size as its target, so each of its documents with words is taken once
    assert order((r.doc_id, r.text) for r in mixed.collect() if (r.text or "").strip()) == order(x for x in want if (x[1] or "").strip())


def test_mixing_takes_each_row_on_its_own(spark):
    # ids are null or shared between the sources, which are taken 1 and 2 of 3 parts
    rows = [(i if i % 4 else None, f"{s} {i} text", "en", s, 1) for s in ("a", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF).collect()
    count = lambda s, null: sum(r.source == s and (r.doc_id is None) == null for r in mixed)
    assert count("a", True) + count("a", False) == 200 and count("b", True) + count("b", False) == 400
    assert 30 <= count("a", True) <= 70 and 75 <= count("b", True) <= 125
