"""Registered queries of language models, beam search, hotwords and segmentation.  Utterances are cut from the driver's
vectors, short enough that SQL can enumerate all alignments; models are trained on the driver's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import beam, charlm, posterior, segment
from corvane.plans.catalog import _CTC, _LATIN, frames, latin, query, t

#: Symbols of the first columns of a vector, the blank first, and the frames of an utterance.
LABELS, FRAMES = ["", " ", "e", "n", "a"], 5
ORDER, ALPHA, BETA, WEIGHT = 3, 0.5, 0.3, 2.0


# ------------------------------------------------------------------ language models as SQL


def lm_sql(source: str, order: int) -> str:
    """CTEs that train on `source` (a query with a column text): mo (gram, logp, backoff) and un (unk)."""
    parts = [
        f"lt AS (SELECT row_number() OVER () AS r, [chr(2)] || string_split(replace(text, ' ', '|'), '') || [chr(3)] AS a FROM ({source}) WHERE length(text) > 0)",
        "lx AS (SELECT r, unnest(a) AS c, unnest(range(1, len(a) + 1)) AS i FROM lt)",
        f"lr AS MATERIALIZED (SELECT gram, count(*) AS n FROM (SELECT i, concat({', '.join([*(f'lag(c, {k}) OVER w' for k in range(order - 1, 0, -1)), 'c'])}) AS gram FROM lx WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE i > 1 GROUP BY gram)",
    ]
    for k in range(order, 0, -1):
        more = f" UNION ALL SELECT substr(gram, 2), 1 FROM l{k + 1}" if k < order else ""
        parts.append(f"l{k} AS MATERIALIZED (SELECT gram, sum(n)::BIGINT AS n FROM (SELECT gram, n FROM lr WHERE length(gram) = {k}{more}) GROUP BY gram)")
    for k in range(1, order + 1):
        parts.append(
            f"d{k} AS (SELECT CASE WHEN ok THEN d1 ELSE 0.5 END::DOUBLE AS d1, CASE WHEN ok THEN d2 ELSE 1.0 END::DOUBLE AS d2, CASE WHEN ok THEN d3 ELSE 1.5 END::DOUBLE AS d3 FROM ("
            "SELECT *, coalesce(least(a, b, c, e) > 0 AND d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3, false) AS ok FROM ("
            "SELECT *, 1 - 2 * y * b / a AS d1, 2 - 3 * y * c / b AS d2, 3 - 4 * y * e / c AS d3 FROM (SELECT *, a / (a + 2 * b) AS y FROM ("
            f"SELECT count_if(n = 1)::DOUBLE AS a, count_if(n = 2)::DOUBLE AS b, count_if(n = 3)::DOUBLE AS c, count_if(n = 4)::DOUBLE AS e FROM l{k})))))"
        )
        parts.append(f"t{k} AS (SELECT gram, substr(gram, 1, {k - 1}) AS ctx, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS taken FROM l{k}, d{k})")
        parts.append(f"c{k} AS MATERIALIZED (SELECT ctx, sum(n)::DOUBLE AS total, sum(taken) / sum(n) AS gamma FROM t{k} GROUP BY ctx)")
        low = "JOIN (SELECT count(*) + 1 AS types FROM l1) ON true" if k == 1 else f"JOIN p{k - 1} b ON b.gram = substr(t{k}.gram, 2)"
        parts.append(f"p{k} AS MATERIALIZED (SELECT t{k}.gram, (n - taken) / total + gamma * {'1.0 / types' if k == 1 else 'b.p'} AS p FROM t{k} JOIN c{k} USING (ctx) {low})")
    known = " UNION ALL ".join(f"SELECT gram, ln(p) AS logp FROM p{k}" for k in range(1, order + 1))
    weights = " UNION ALL ".join(f"SELECT ctx AS gram, ln(gamma) AS backoff FROM c{k}" for k in range(2, order + 1))
    parts.append(f"mo AS MATERIALIZED (SELECT coalesce(x.gram, y.gram) AS gram, logp, coalesce(backoff, 0) AS backoff FROM ({known}) x FULL JOIN ({weights}) y ON x.gram = y.gram)")
    parts.append("un AS (SELECT ln(gamma / (SELECT count(*) + 1 FROM l1)) AS unk FROM c1)")
    return ", ".join(parts)


def score_sql(source: str, order: int) -> str:
    """CTE ls (id, lm): the log probabilities of the texts of `source` (a query with id and text), END included."""
    return (
        f"qa AS MATERIALIZED (SELECT id, [chr(2)] || list_filter(string_split(replace(text, ' ', '|'), ''), lambda x: x <> '') || [chr(3)] AS a FROM ({source})), "
        f"qg AS (SELECT id, unnest(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, least({order}, i) + 1), lambda k: {{'i': i, 'k': k, 'gram': array_to_string(a[i - k + 1:i], '')}})))) AS g FROM qa), "
        "qm AS MATERIALIZED (SELECT id, g.i AS i, g.k AS k, logp, backoff FROM qg JOIN mo ON g.gram = mo.gram), "
        "qe AS (SELECT id, i, max(k) AS m, arg_max(logp, k) AS logp FROM qm WHERE logp IS NOT NULL AND i > 1 GROUP BY ALL), "
        "qp AS (SELECT id, unnest(range(2, len(a) + 1)) AS i FROM qa), "
        f"qb AS (SELECT p.id, p.i, any_value(coalesce(e.logp, unk)) + coalesce(sum(b.backoff), 0) AS lp FROM qp p CROSS JOIN un LEFT JOIN qe e ON e.id = p.id AND e.i = p.i LEFT JOIN qm b ON b.id = p.id AND b.i = p.i - 1 AND b.k < {order} AND b.k >= coalesce(e.m, 0) GROUP BY p.id, p.i), "
        "ls AS MATERIALIZED (SELECT id, sum(lp) AS lm FROM qb GROUP BY id)"
    )


_BENCH_TEXT, _DOC_TEXT = (f"SELECT {_LATIN.format(c='text')} AS text FROM {x}" for x in ("benchmark", "documents"))


@query(f"WITH {lm_sql(_DOC_TEXT, 6)}, {score_sql('SELECT item_id AS id, ' + _LATIN.format(c='text') + ' AS text FROM benchmark', 6)} SELECT id AS item_id, len(a) - 1 AS tokens, CASE WHEN len(a) > 2 THEN round(lm, 5) END AS score FROM qa JOIN ls USING (id)")
def char_lm_scores(spark, d):
    """A language model of six characters, trained on all documents, over the benchmark's texts."""
    model = charlm.fit(t(spark, d, "documents").select(latin("text").alias("text")), "text", 6)
    return charlm.score(t(spark, d, "benchmark").select("item_id", latin("text").alias("text")), "item_id", "text", model, 6).withColumn("score", F.round("score", 5))


# ------------------------------------------------------------------ beams


def utterances(spark, d) -> DataFrame:
    """(unit, t, logp): a few frames in a row of each label, over the first columns."""
    unit = (F.col("label").cast("bigint") * 100_000 + F.floor(F.col("t") / FRAMES)).alias("unit")
    return frames(spark, d).select(unit, "t", posterior.select_columns(F.col("logp"), 0, 1, len(LABELS) - 1).alias("logp"))


_MASSES = f"""{_CTC}, us AS (SELECT label::BIGINT * 100000 + t // {FRAMES} AS unit, t % {FRAMES} AS i, list_transform(q[1:{len(LABELS)}], lambda x: x - ln(list_sum(list_transform(q[1:{len(LABELS)}], lambda y: exp(y))))) AS v FROM q),
sy AS (SELECT unit, i, k - 1 AS k, v[k] AS lp, {LABELS}[k] AS s FROM us, (SELECT unnest(range(1, {len(LABELS) + 1})) AS k)),
pa AS (SELECT unit, i, k, CASE WHEN k > 0 THEN s ELSE '' END AS text, lp FROM sy WHERE i = 0
  UNION ALL SELECT sy.unit, sy.i, sy.k, CASE WHEN sy.k = 0 OR sy.k = pa.k THEN pa.text ELSE pa.text || sy.s END, pa.lp + sy.lp FROM pa JOIN sy ON sy.unit = pa.unit AND sy.i = pa.i + 1),
ma AS MATERIALIZED (SELECT unit, text, max(lp) + ln(sum(exp(lp - top))) - (max(lp) - any_value(top)) AS am FROM (SELECT unit, text, lp, max(lp) OVER (PARTITION BY unit, text) AS top FROM pa WHERE i = (SELECT max(i) FROM us WHERE us.unit = pa.unit)) GROUP BY unit, text)"""
_NO_SPACE = "length(replace(text, ' ', ''))"


@query(f"WITH RECURSIVE {_MASSES} SELECT unit, rank, text, round(am, 6) AS acoustic FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY am DESC, text) AS rank FROM ma) WHERE rank <= 5")
def ctc_beam(spark, d):
    """The five best texts of each utterance, all alignments of each summed."""
    b = beam.decode(utterances(spark, d), "unit", "t", "logp", LABELS, width=None, top=5)
    return b.select("unit", "rank", "text", F.round("acoustic", 6).alias("acoustic"))


_HOT = "SELECT DISTINCT unnest(string_split(" + _LATIN.format(c="text") + ", ' ')) AS word FROM benchmark"
_LM_BENCH = f"{lm_sql(_BENCH_TEXT, ORDER)}, {score_sql('SELECT DISTINCT text AS id, text FROM ma', ORDER)}"


@query(
    f"WITH RECURSIVE {_MASSES}, {_LM_BENCH}, hw AS (SELECT word FROM ({_HOT}) WHERE length(word) BETWEEN 2 AND 5), "
    "hs AS (SELECT id, (SELECT count(*) FROM (SELECT unnest(string_split(id, ' ')) AS w) JOIN hw ON w = word) AS n FROM ls), "
    f"z AS (SELECT unit, text, am, lm, {WEIGHT} * n AS hot, am + {ALPHA} * lm + {BETA} * {_NO_SPACE} + {WEIGHT} * n AS total FROM ma JOIN ls ON ls.id = text JOIN hs ON hs.id = text) "
    "SELECT unit, rank, text, round(lm, 5) AS lm, hot::DOUBLE AS hot, round(total, 5) AS total FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY total DESC, text) AS rank FROM z) WHERE rank <= 3"
)
def ctc_beam_with_model(spark, d):
    """The same under a language model of the benchmark's texts and with its short words as hotwords."""
    texts = t(spark, d, "benchmark").select(latin("text").alias("text"))
    hot = texts.select(F.explode(F.split("text", " ")).alias("word")).where(F.length("word").between(2, 5))
    b = beam.decode(utterances(spark, d), "unit", "t", "logp", LABELS, width=None, top=3, model=charlm.fit(texts, "text", ORDER), alpha=ALPHA, beta=BETA, hotwords=hot, weight=WEIGHT)
    return b.select("unit", "rank", "text", F.round("lm", 5).alias("lm"), "hot", F.round("total", 5).alias("total"))


@query(
    f"WITH RECURSIVE {_MASSES}, {_LM_BENCH}, nb AS (SELECT * FROM ma QUALIFY row_number() OVER (PARTITION BY unit ORDER BY am DESC, text) <= 10), al AS (SELECT unnest([0.0, 0.6, 1.0, 1.4, 2.0, 2.8, 4.0])::DOUBLE AS alpha), "
    f"z AS (SELECT alpha, unit, text, am + alpha * CASE WHEN text = '' THEN -1e9 ELSE lm END + 0.1 * {_NO_SPACE} AS total FROM nb JOIN ls ON ls.id = text, al) "
    "SELECT alpha, unit, text, round(total, 5) AS total FROM z QUALIFY row_number() OVER (PARTITION BY alpha, unit ORDER BY total DESC, text DESC) = 1"
)
def lm_rescored_beams(spark, d):
    """The ten best texts by sound alone, rescored under each weight of a language model."""
    model = charlm.fit(t(spark, d, "benchmark").select(latin("text").alias("text")), "text", ORDER)
    n_best = beam.decode(utterances(spark, d), "unit", "t", "logp", LABELS, width=None, top=10)
    best = beam.rescored(n_best, "unit", "text", "acoustic", model, [0.0, 0.6, 1.0, 1.4, 2.0, 2.8, 4.0], beta=0.1, order=ORDER)
    return best.select("alpha", "unit", "text", F.round("total", 5).alias("total"))


@query()
def hotword_beams(spark, d):
    """Whole utterances over letters, with the benchmark's words of five letters and more as hotwords, in a beam."""
    labels = ["", " ", *(chr(97 + i) for i in range(26))]
    hot = t(spark, d, "benchmark").select(F.explode(F.split(latin("text"), " ")).alias("word")).where(F.length("word") >= 5)
    f = frames(spark, d).select("label", "t", posterior.select_columns(F.col("logp"), 0, 1, 27).alias("logp"))
    return beam.decode(f, "label", "t", "logp", labels, width=20, top=1, hotwords=hot, weight=10.0)


# ------------------------------------------------------------------ segmentation


_SEGMENTS = f"""{_CTC}, ut AS (SELECT label, list_filter(list_transform(range(0, len(ids) // 8), lambda u: ids[8 * u + 5:8 * u + 10]), lambda x: len(x) > 0) AS us FROM y),
gx AS (SELECT label, us, flatten(list_transform(us, lambda x, u: CASE WHEN u > 1 THEN [0] || x ELSE x END)) AS g, flatten(list_transform(us, lambda x, u: CASE WHEN u > 1 THEN [-1] ELSE []::INT[] END || list_transform(x, lambda i: u - 1))) AS own FROM ut WHERE len(us) > 0),
tr AS (SELECT label, 0 AS t, [0.0::DOUBLE] || list_transform(g, lambda x: -1e30::DOUBLE) AS d, NULL::BOOLEAN[] AS stayed FROM gx
  UNION ALL SELECT tr.label, tr.t + 1, [0.0::DOUBLE] || list_transform(g, lambda x, c: greatest(d[c] + q[x + 1], d[c + 1] + greatest(q[1], q[x + 1]))), list_transform(g, lambda x, c: d[c + 1] + greatest(q[1], q[x + 1]) > d[c] + q[x + 1])
    FROM tr JOIN gx ON gx.label = tr.label JOIN q ON q.label = tr.label AND q.t = tr.t),
ed AS (SELECT label, t AS end_, len(d) - 1 AS c FROM tr WHERE d[len(d)] > -1e29 QUALIFY row_number() OVER (PARTITION BY label ORDER BY d[len(d)] DESC, t) = 1),
bk AS (SELECT label, end_ AS t, c, -1::BIGINT AS fr, NULL::BIGINT AS tok, NULL::BOOLEAN AS enters FROM ed
  UNION ALL SELECT bk.label, bk.t - 1, CASE WHEN stayed[bk.c] THEN bk.c ELSE bk.c - 1 END, bk.t - 1, bk.c, NOT stayed[bk.c] FROM bk JOIN tr ON tr.label = bk.label AND tr.t = bk.t WHERE bk.c > 0),
pf AS (SELECT bk.label, fr, tok, enters, CASE WHEN enters THEN q[g[tok] + 1] ELSE greatest(q[1], q[g[tok] + 1]) END AS p FROM bk JOIN gx USING (label) JOIN q ON q.label = bk.label AND q.t = fr WHERE tok IS NOT NULL),
en AS (SELECT label, tok, fr FROM pf WHERE enters),
ub AS (SELECT gx.label, u - 1 AS u, list_position(own, u - 1) AS a, len(own) - list_position(list_reverse(own), u - 1) + 1 AS b, len(own) AS m FROM gx, (SELECT unnest(range(1, 1000)) AS u) WHERE u <= len(us)),
ue AS (SELECT ub.label, u, f.fr AS first, l.fr AS last, coalesce(p.fr, f.fr) AS before, coalesce(n.fr, end_) AS after FROM ub JOIN ed USING (label) JOIN en f ON f.label = ub.label AND f.tok = a JOIN en l ON l.label = ub.label AND l.tok = b LEFT JOIN en p ON p.label = ub.label AND p.tok = a - 1 LEFT JOIN en n ON n.label = ub.label AND n.tok = b + 1),
wi AS (SELECT ue.label, u, x.fr, avg(y.p) AS mean FROM ue JOIN pf x ON x.label = ue.label AND x.fr BETWEEN first AND after - 1 JOIN pf y ON y.label = ue.label AND y.fr BETWEEN x.fr AND least(x.fr + 3, after - 1) WHERE x.fr = first OR x.fr + 3 <= after - 1 GROUP BY ALL)"""


@query(
    f"WITH RECURSIVE {_SEGMENTS} SELECT ue.label, ue.u AS utterance, round(greatest(first * 0.5 - 0.5, (first + before) / 2 * 0.5), 6)::DOUBLE AS start_s, round(least(last * 0.5 + 0.5, (last + after) / 2 * 0.5), 6)::DOUBLE AS end_s, "
    "round(score, 6) AS score, first AS first_frame, after AS end_frame FROM ue JOIN (SELECT label, u, min(mean) AS score FROM wi GROUP BY ALL) s ON s.label = ue.label AND s.u = ue.u"
)
def ctc_segmentation(spark, d):
    """Utterances of up to six tokens, with tokens left out before, between and after them, found in each label's frames."""
    f = frames(spark, d)
    ids = posterior.greedy(f, "label", "t", "logp").select("label", "ids").where(F.size("ids") >= 8)
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("ids") / 8).cast("int") - 1), lambda u: F.slice("ids", 8 * u + 5, 6))
    texts = ids.select("label", F.posexplode(F.filter(cut, lambda x: F.size(x) > 0)).alias("utterance", "ids")).withColumn("utterance", F.col("utterance").cast("bigint"))
    s = segment.ctc_segments(f, texts, "label", "utterance", "ids", 0.5, window=None, span=4)
    return s.select("label", "utterance", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.round("score", 6).alias("score"), "first_frame", "end_frame")
