"""Registered queries over pairs of benchmark items, short enough that SQL can fill whole alignment tables of characters; and
reports and greedy selections as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import align, edit, script
from corvane.functions.text import words
from corvane.operators import fusion, metrics
from corvane.plans.catalog import _LATIN, _PAIRS, _WORDS, QUERIES, SQL, latin, query, t
from corvane.plans.derived import _deva, deva


def item_pairs(spark, d) -> DataFrame:
    """Each item's text (ref) with that of the item of the next number (hyp)."""
    b = t(spark, d, "benchmark").select("item_id", latin("text").alias("ref"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("ref").alias("hyp")), "item_id")


_ITEMS = f"bi AS (SELECT item_id, {_LATIN.format(c='text')} AS ref FROM benchmark), pr AS (SELECT a.item_id AS id, a.ref, b.ref AS hyp FROM bi a JOIN bi b ON b.item_id = a.item_id + 1)"


def trace_sql(pairs: str, tag: str = "") -> str:
    """CTE op{tag} (id, op, ri, hi, rc, hc): the alignment of the lists r and h of each row of `pairs` (id, r, h), 0-based."""
    return f"""pa{tag} AS MATERIALIZED ({pairs}),
dp{tag} AS (SELECT id, 0 AS i, range(0, len(h) + 1)::INT[] AS d FROM pa{tag}
  UNION ALL SELECT id, i + 1, list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(u[1:j], lambda x, k: x - k)) + j)::INT[] FROM (
    SELECT dp{tag}.*, h, [i + 1] || list_transform(range(1, len(h) + 1), lambda j: least(d[j + 1] + 1, d[j] + (r[i + 1] <> h[j])::INT)) AS u FROM dp{tag} JOIN pa{tag} USING (id) WHERE i < len(r))),
tr{tag} AS (SELECT id, len(r)::INT AS i, len(h)::INT AS j, NULL::VARCHAR AS op, 0 AS ri, 0 AS hi FROM pa{tag}
  UNION ALL SELECT id, CASE WHEN o = 'I' THEN i ELSE i - 1 END, CASE WHEN o = 'D' THEN j ELSE j - 1 END, o, i - 1, CASE WHEN o = 'D' THEN -1 ELSE j - 1 END FROM (
    SELECT tr{tag}.id, tr{tag}.i, tr{tag}.j, CASE WHEN tr{tag}.i > 0 AND tr{tag}.j > 0 AND r[tr{tag}.i] = h[tr{tag}.j] THEN 'M' WHEN tr{tag}.i > 0 AND tr{tag}.j > 0 AND a.d[tr{tag}.j + 1] = b.d[tr{tag}.j] + 1 THEN 'S' WHEN tr{tag}.i > 0 AND a.d[tr{tag}.j + 1] = b.d[tr{tag}.j + 1] + 1 THEN 'D' ELSE 'I' END AS o
    FROM tr{tag} JOIN pa{tag} USING (id) JOIN dp{tag} a ON a.id = tr{tag}.id AND a.i = tr{tag}.i LEFT JOIN dp{tag} b ON b.id = tr{tag}.id AND b.i = tr{tag}.i - 1 WHERE tr{tag}.i + tr{tag}.j > 0)),
op{tag} AS MATERIALIZED (SELECT tr{tag}.id, op, ri, hi, CASE WHEN op <> 'I' THEN r[ri + 1] END AS rc, CASE WHEN op <> 'D' THEN h[hi + 1] END AS hc FROM tr{tag} JOIN pa{tag} USING (id) WHERE op IS NOT NULL)"""


_CHARS = trace_sql("SELECT id, string_split(replace(ref, ' ', ''), '') AS r, string_split(replace(hyp, ' ', ''), '') AS h FROM pr WHERE length(ref) > 0 AND length(hyp) > 0")


@query(
    f"WITH RECURSIVE {_ITEMS}, {_CHARS}, ow AS (SELECT id, flatten(list_transform({_WORDS.format(c='ref')}, lambda w, i: list_transform(range(0, length(w)), lambda k: i - 1))) AS own, len({_WORDS.format(c='ref')}) AS n_words FROM pr), "
    "z AS (SELECT id, count(DISTINCT own[greatest(ri, 0) + 1]) FILTER (op IN ('S', 'D', 'I')) AS strict, count(DISTINCT own[ri + 1]) FILTER (op IN ('S', 'D')) AS lenient, count(*) FILTER (op = 'I') AS n_ins FROM op JOIN ow USING (id) GROUP BY id) "
    "SELECT id AS item_id, n_words::INT AS n_words, strict::INT AS bad_strict, lenient::INT AS bad_lenient, n_ins::INT AS n_ins, lenient / n_words::DOUBLE AS sn_wer_lo, strict / n_words::DOUBLE AS sn_wer_hi FROM z JOIN ow USING (id)"
)
def spaceless_items(spark, d):
    """Words of each item damaged in the next one, spaces left out of the alignment."""
    s = item_pairs(spark, d).select("item_id", align.spaceless("ref", "hyp").alias("s")).select("item_id", "s.*")
    return s.withColumns({"sn_wer_lo": F.try_divide("bad_lenient", "n_words"), "sn_wer_hi": F.try_divide("bad_strict", "n_words")})


@query(f"WITH RECURSIVE {_ITEMS}, {_CHARS} SELECT op, rc, hc, count(*) AS count FROM op WHERE op IN ('S', 'D') GROUP BY ALL")
def confusions_of_items(spark, d):
    return metrics.confusions(metrics.char_ops(item_pairs(spark, d)))


@query(
    f"WITH RECURSIVE {_ITEMS}, {_CHARS}, v AS (SELECT id % 3 AS part, rc IN ('a', 'e', 'i', 'o', 'u') AS r, hc IN ('a', 'e', 'i', 'o', 'u') AS h, op FROM op) "
    "SELECT part, count(*) FILTER (r) AS ref_n, count(*) FILTER (r AND op = 'M') AS matched, count(*) FILTER (h) AS hyp_n, matched / ref_n::DOUBLE AS recall, hyp_n / ref_n::DOUBLE AS over_insertion FROM v GROUP BY part"
)
def vowels_of_items(spark, d):
    return metrics.family_recall(metrics.char_ops(item_pairs(spark, d).withColumn("part", F.col("item_id") % 3), "part"), "aeiou", "part")


@query(f"WITH RECURSIVE {_ITEMS}, {_CHARS} SELECT least(ri // 10, 15)::INT AS decade, count(*) AS n, count(*) FILTER (op <> 'M') AS errors FROM op WHERE op <> 'I' GROUP BY 1")
def char_positions_of_items(spark, d):
    """Errors of reference characters by place in the text, in tens."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    ops = item_pairs(spark, d).select(F.explode(align.char_ops(bare("ref"), bare("hyp"))).alias("o")).where("o.op <> 'I'")
    return ops.groupBy(F.least(F.floor(F.col("o.ri") / 10), F.lit(15)).cast("int").alias("decade")).agg(F.count("*").alias("n"), F.count_if(F.col("o.op") != "M").alias("errors"))


def _category(rc: str, hc: str) -> str:
    tests = []
    for name, groups in metrics.TAXONOMY:
        hit = " OR ".join(f"(contains('{g}', {rc}) AND contains('{g}', {hc}))" for g in groups)
        tests.append(f"WHEN {hit} THEN '{name}'")
    return f"CASE {' '.join(tests)} ELSE 'other' END"


_DEVA_ITEMS = (
    f"bi AS (SELECT item_id, {_deva(_LATIN.format(c='text'))} AS ref FROM benchmark), pr AS (SELECT a.item_id AS id, a.ref, b.ref AS hyp FROM bi a JOIN bi b ON b.item_id = a.item_id + 1), "
    + trace_sql(f"SELECT id, {_WORDS.format(c='ref')} AS r, {_WORDS.format(c='hyp')} AS h FROM pr", "w")
    + ", su AS MATERIALIZED (SELECT rc, hc, count(*) AS count FROM opw WHERE op = 'S' GROUP BY ALL), "
    + trace_sql("SELECT {'a': rc, 'b': hc} AS id, string_split(rc, '') AS r, string_split(hc, '') AS h FROM su", "c")
)


def deva_pairs(spark, d) -> DataFrame:
    p = item_pairs(spark, d)
    return p.select("item_id", deva(F.col("ref")).alias("ref"), deva(F.col("hyp")).alias("hyp"))


@query(
    f"WITH RECURSIVE {_DEVA_ITEMS}, o AS (SELECT id.a AS rc, id.b AS hc, count(*) FILTER ({_category('rc', 'hc')} = 'other') AS other FROM opc WHERE op = 'S' GROUP BY ALL) "
    "SELECT rc, hc, count, other, least(other / greatest(length(rc), 1)::DOUBLE, 1.0) AS share FROM o JOIN su USING (rc, hc) WHERE other > 0 ORDER BY other DESC, encode(rc), encode(hc) LIMIT 40"
)
def unlike_words_of_items(spark, d):
    """The replaced words whose substitutions are least like each other, in Devanagari."""
    return metrics.unlike_words(deva_pairs(spark, d))


@query(f"WITH RECURSIVE {_DEVA_ITEMS} SELECT {_category('rc', 'hc')} AS kind, count(*) AS n FROM opc WHERE op = 'S' GROUP BY 1")
def kinds_of_substitutions(spark, d):
    """Classes of the substituted characters within replaced words."""
    subs = deva_pairs(spark, d).select(F.explode(align.word_ops("ref", "hyp")).alias("o")).where("o.op = 'S'").select("o.rc", "o.hc").distinct()
    ops = subs.select(F.explode(align.char_ops("rc", "hc")).alias("o")).where("o.op = 'S'")
    return ops.groupBy(metrics.category(F.col("o.rc"), F.col("o.hc")).alias("kind")).agg(F.count("*").alias("n"))


_CONSENSUS = "bi AS (SELECT item_id, " + _WORDS.format(c=_LATIN.format(c="text")) + " AS w FROM benchmark)"


@query(
    f"WITH RECURSIVE {_CONSENSUS}, {trace_sql('SELECT {{a: a.item_id, k: k}} AS id, a.w AS r, b.w AS h FROM bi a, (SELECT unnest([1, 2, 3]) AS k) JOIN bi b ON b.item_id = a.item_id + k'.replace('{{a: a.item_id, k: k}}', chr(123) + chr(39) + 'a' + chr(39) + ': a.item_id, ' + chr(39) + 'k' + chr(39) + ': k' + chr(125)))}, "
    "u AS (SELECT id.a AS item_id, ri, list(op ORDER BY id.k) AS ops, list(CASE WHEN op = 'S' THEN hc ELSE '' END ORDER BY id.k) AS heard FROM op WHERE op <> 'I' GROUP BY ALL HAVING count(*) = 3), "
    "z AS (SELECT item_id, len(list_filter(ops, lambda o: o = 'M')) AS hits, len(list_filter(ops, lambda o: o = 'S')) AS subs, len(list_distinct(heard)) AS kinds FROM u) "
    "SELECT CASE hits WHEN 3 THEN 'green' WHEN 0 THEN 'red' ELSE 'amber' END AS strict, CASE WHEN hits > 0 THEN 'green' WHEN subs = 3 AND kinds = 1 THEN 'red' ELSE 'amber' END AS liberal, count(*) AS n FROM z GROUP BY ALL"
)
def consensus_of_items(spark, d):
    """Bands of each item's words in the three items after it."""
    b = t(spark, d, "benchmark").select("item_id", words(latin("text")).alias("w"))
    c = b.withColumnRenamed("w", "ref")
    for k in (1, 2, 3):
        c = c.join(b.select((F.col("item_id") - k).alias("item_id"), F.col("w").alias(f"h{k}")), "item_id")
    units = c.select(F.explode(fusion.consensus(F.col("ref"), [F.col("h1"), F.col("h2"), F.col("h3")])).alias("o"))
    strict, liberal = fusion.bands(F.col("o"))
    return units.groupBy(strict.alias("strict"), liberal.alias("liberal")).agg(F.count("*").alias("n"))


@query(
    "WITH e AS (SELECT doc_id, length(text) AS n, levenshtein(lang, source) AS edits, length(lang) AS ln, length(source) AS sn FROM documents), p AS (SELECT unnest(['one', 'accumulate', 'skip']) AS policy) "
    "SELECT policy, count(rate) AS rows, round(avg(rate), 6) AS mean FROM (SELECT policy, CASE WHEN (doc_id % 7 > 0)::INT * ln = 0 THEN CASE WHEN policy = 'one' THEN CASE WHEN sn = 0 THEN 0.0 ELSE 1.0 END END ELSE edits / ln::DOUBLE END AS rate FROM e, p) GROUP BY policy"
)
def row_rates(spark, d):
    """Rates of rows, some with an empty reference, under each policy for those."""
    docs = t(spark, d, "documents")
    length = F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.length("lang"))
    rates = [F.struct(F.lit(p).alias("policy"), edit.row_rate(F.levenshtein("lang", "source"), length, F.length("source"), p).alias("rate")) for p in edit.EMPTY_REF]
    return docs.select(F.explode(F.array(*rates)).alias("r")).groupBy("r.policy").agg(F.count("r.rate").alias("rows"), F.round(F.avg("r.rate"), 6).alias("mean"))


# ------------------------------------------------------------------ longest common blocks


def blocks_sql(pairs: str, tag: str = "") -> str:
    """CTEs mb{tag} (id, i, j, k): the longest common block of the lists a and b of each row of `pairs` (id, a, b), then those
    to its left and right, and so on, the first of equal ones, adjacent ones joined; and oc{tag} (id, tag, i1, i2, j1, j2), the
    opcodes between them."""
    t_ = tag
    return f"""pb{t_} AS MATERIALIZED ({pairs}),
eq{t_} AS (SELECT x.id, x.i, y.j FROM (SELECT id, unnest(a) AS w, unnest(range(len(a))) AS i FROM pb{t_}) x JOIN (SELECT id, unnest(b) AS w, unnest(range(len(b))) AS j FROM pb{t_}) y ON x.id = y.id AND x.w = y.w),
rn{t_} AS MATERIALIZED (SELECT id, i, j, max(i) OVER (PARTITION BY id, i - j, g) - i + 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM eq{t_})),
rg{t_} AS (SELECT id, 'p' AS kind, 0::BIGINT AS alo, len(a)::BIGINT AS ahi, 0::BIGINT AS blo, len(b)::BIGINT AS bhi FROM pb{t_}
  UNION ALL SELECT id, CASE c WHEN 0 THEN 'b' ELSE 'p' END, CASE c WHEN 0 THEN -m[2] WHEN 1 THEN alo ELSE m[1] - m[2] END, CASE c WHEN 0 THEN m[1] - m[2] WHEN 1 THEN -m[2] ELSE ahi END, CASE c WHEN 0 THEN -m[3] WHEN 1 THEN blo ELSE m[1] - m[3] END, CASE c WHEN 0 THEN m[1] - m[3] WHEN 1 THEN -m[3] ELSE bhi END
    FROM (SELECT g.id, alo, ahi, blo, bhi, max([least(n, ahi - i, bhi - j), -i, -j]) AS m FROM rg{t_} g JOIN rn{t_} r ON r.id = g.id AND i >= alo AND i < ahi AND j >= blo AND j < bhi WHERE g.kind = 'p' GROUP BY ALL), (SELECT unnest([0, 1, 2]) AS c)),
bk{t_} AS (SELECT id, alo AS i, blo AS j, ahi - alo AS k FROM rg{t_} WHERE kind = 'b'),
mb{t_} AS MATERIALIZED (SELECT id, min(i) AS i, min(j) AS j, sum(k)::BIGINT AS k FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS isle FROM (SELECT *, coalesce(lag(i + k) OVER w <> i OR lag(j + k) OVER w <> j, true)::INT AS new FROM bk{t_} WINDOW w AS (PARTITION BY id ORDER BY i))) GROUP BY id, isle),
oc{t_} AS MATERIALIZED (SELECT id, CASE WHEN i2 > i1 AND j2 > j1 THEN 'replace' WHEN i2 > i1 THEN 'delete' ELSE 'insert' END AS tag, i1, i2, j1, j2 FROM (
  SELECT id, coalesce(lag(i + k) OVER w, 0) AS i1, i AS i2, coalesce(lag(j + k) OVER w, 0) AS j1, j AS j2 FROM (SELECT * FROM mb{t_} UNION ALL SELECT id, len(a), len(b), 0 FROM pb{t_}) WINDOW w AS (PARTITION BY id ORDER BY i, j, k DESC)) WHERE i2 > i1 OR j2 > j1)"""


_SPLIT = "SELECT id, string_split(ref, ' ') AS a, string_split(hyp, ' ') AS b FROM pr"
_BARE = "list_filter(string_split(replace({c}, ' ', ''), ''), lambda x: x <> '')"


@query(f"WITH RECURSIVE {_ITEMS}, {blocks_sql(_SPLIT)} SELECT id AS item_id, 2 * coalesce(sum(k), 0)::DOUBLE / any_value(len(a) + len(b)) AS ratio FROM pb LEFT JOIN mb USING (id) GROUP BY id")
def word_ratios_of_items(spark, d):
    """How alike the words of neighbouring items are: twice the words in common blocks over all."""
    codes = item_pairs(spark, d).select("item_id", F.split("ref", " ").alias("a"), F.split("hyp", " ").alias("b"), align.word_opcodes("ref", "hyp").alias("c"))
    same = F.aggregate(F.filter("c", lambda c: c["tag"] == "equal"), F.lit(0), lambda n, c: n + c["i2"] - c["i1"])
    return codes.select("item_id", (2 * same.cast("double") / (F.size("a") + F.size("b"))).alias("ratio"))


@query(f"WITH RECURSIVE {_ITEMS}, {blocks_sql('SELECT id, ' + _BARE.format(c='ref') + ' AS a, ' + _BARE.format(c='hyp') + ' AS b FROM pr')} SELECT id AS item_id, round(2 * coalesce(sum(k), 0)::DOUBLE / any_value(len(a) + len(b)), 9) AS ratio FROM pb LEFT JOIN mb USING (id) GROUP BY id")
def match_ratios_of_items(spark, d):
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return item_pairs(spark, d).select("item_id", F.round(align.match_ratio(bare("ref"), bare("hyp")), 9).alias("ratio"))


_KINDS = f"""{blocks_sql('SELECT id, ' + _BARE.format(c='hyp') + ' AS a, ' + _BARE.format(c='ref') + ' AS b FROM pr')},
sb AS (SELECT oc.*, least(i2 - i1, j2 - j1) AS bo FROM oc),
kd AS (SELECT kind, count(*) AS n FROM (SELECT {_category('rc', 'hc')} AS kind FROM (SELECT b[j1 + t + 1] AS rc, a[i1 + t + 1] AS hc FROM (SELECT *, unnest(range(bo)) AS t FROM sb) JOIN pb USING (id))) GROUP BY kind
  UNION ALL SELECT 'insertion', sum(i2 - i1 - bo) FROM sb UNION ALL SELECT 'deletion', sum(j2 - j1 - bo) FROM sb)"""


@query(
    f"WITH RECURSIVE bi AS (SELECT item_id, {_deva(_LATIN.format(c='text'))} AS ref FROM benchmark), pr AS (SELECT a.item_id AS id, a.ref, b.ref AS hyp FROM bi a JOIN bi b ON b.item_id = a.item_id + 1), {_KINDS} "
    "SELECT kind, n::BIGINT AS n, n / sum(n) OVER ()::DOUBLE AS share FROM kd WHERE n > 0"
)
def edit_kinds_of_items(spark, d):
    """Edit operations by class, in Devanagari, from longest common blocks of characters."""
    return metrics.breakdown(deva_pairs(spark, d))


_THREE = f"bi AS (SELECT item_id, replace({_LATIN.format(c='text')}, ' ', '') AS ref FROM benchmark), pr AS (SELECT {{'i': a.item_id, 'k': k}} AS id, a.ref, b.ref AS hyp FROM bi a, (SELECT unnest([1, 2]) AS k) JOIN bi b ON b.item_id = a.item_id + k)"


@query(
    f"WITH RECURSIVE {_THREE}, {blocks_sql('SELECT id, ' + _BARE.format(c='ref') + ' AS a, ' + _BARE.format(c='hyp') + ' AS b FROM pr')}, "
    "ce AS (SELECT id, i + t AS p, b[j + t + 1] AS x FROM (SELECT *, unnest(range(k)) AS t FROM mb) JOIN pb USING (id) UNION ALL SELECT id, i1 + t, b[j1 + t + 1] FROM (SELECT *, unnest(range(least(i2 - i1, j2 - j1))) AS t FROM oc WHERE tag = 'replace') JOIN pb USING (id)), "
    "ba AS (SELECT id.i AS item_id, unnest(a) AS x, unnest(range(len(a))) AS p FROM pb WHERE id.k = 1 AND id.i + 2 IN (SELECT item_id FROM bi)), "
    "vo AS (SELECT ba.item_id, ba.p, CASE WHEN coalesce(o.x, '') = coalesce(q.x, '') THEN coalesce(o.x, '') ELSE ba.x END AS x FROM ba LEFT JOIN ce o ON o.id.i = ba.item_id AND o.id.k = 1 AND o.p = ba.p LEFT JOIN ce q ON q.id.i = ba.item_id AND q.id.k = 2 AND q.p = ba.p) "
    "SELECT item_id, string_agg(x, '' ORDER BY p) AS voted FROM vo GROUP BY item_id"
)
def votes_of_items(spark, d):
    """Each item's characters, overridden where the two items after it agree."""
    b = t(spark, d, "benchmark").select("item_id", F.replace(latin("text"), F.lit(" "), F.lit("")).alias("a"))
    every = b
    for k, name in ((1, "b"), (2, "c")):
        b = b.join(every.select((F.col("item_id") - k).alias("item_id"), F.col("a").alias(name)), "item_id")
    return b.where("length(a) > 0").select("item_id", fusion.rover(F.col("a"), F.col("b"), F.col("c")).alias("voted"))


@query(
    f"WITH RECURSIVE bi AS (SELECT item_id AS id, {_WORDS.format(c=_LATIN.format(c='text'))} AS a FROM benchmark), {blocks_sql('SELECT id, a, list_transform(a, lambda w, i: CASE WHEN (i * 7 + id) % 5 = 0 THEN reverse(w) ELSE w END) AS b FROM bi')}, "
    "lx AS (SELECT w FROM (SELECT unnest(a) AS w FROM bi) GROUP BY w HAVING count(*) >= 3), "
    "r AS (SELECT id, i AS start, i + k AS end_, len(a) AS n, a[i + 1:i + k] AS run, list_transform(range(i + 1, i + k + 1), lambda x: (x * 13 + id) % 10 / 10.0::DOUBLE) AS conf FROM mb JOIN pb USING (id) WHERE k >= 3), "
    "y AS (SELECT id, start, end_, n, array_to_string(run, ' ') AS text, count(lx.w) / count(*)::DOUBLE AS share FROM (SELECT *, unnest(run) AS w FROM r WHERE list_sum(conf) / len(conf) >= 0.45) LEFT JOIN lx USING (w) GROUP BY ALL) "
    "SELECT id AS item_id, start::INT AS start, end_::INT AS \"end\", text, round(share, 6) AS corpus_share, round(greatest(start * 0.4 - 0.1, 0), 6)::DOUBLE AS from_s, round(least(end_ * 0.4 + 0.1, n * 0.4), 6)::DOUBLE AS to_s FROM y WHERE share >= 0.6 AND least(end_ * 0.4 + 0.1, n * 0.4) - greatest(start * 0.4 - 0.1, 0) BETWEEN 1 AND 18"
)
def confident_runs_of_items(spark, d):
    """Runs of words that an item shares with a copy of which some words are changed, by confidence and corpus share."""
    w = words(latin("text"))
    b = t(spark, d, "benchmark").select("item_id", w.alias("w"))
    lx = b.select(F.explode("w").alias("word")).groupBy("word").count().where("count >= 3")
    changed = F.transform("w", lambda x, i: F.when(((i + 1) * 7 + F.col("item_id")) % 5 == 0, F.reverse(x)).otherwise(x))
    conf = F.transform("w", lambda x, i: ((i + 1) * 13 + F.col("item_id")) % 10 / F.lit(10.0))
    p = b.select("item_id", F.array_join("w", " ").alias("a"), F.array_join(changed, " ").alias("b"), conf.alias("conf"))
    r = fusion.gated_runs(p, ["item_id"], "a", "b", lx, 0.4, confidence="conf", least_conf=0.45)
    return r.withColumns({c: F.round(c, 6) for c in ("corpus_share", "from_s", "to_s")})


# ------------------------------------------------------------------ Roman schemes


SCHEMES = ("iast", "slp1", "hk", "itrans", "velthuis")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _map(pairs: dict) -> str:
    return f"MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in pairs.items())}}}"


def _written(scheme: str, x: str) -> str:
    """Devanagari in a Roman scheme: a consonant has the first vowel unless a sign or virama follows."""
    vowels, consonants, marks = script._ROMAN[scheme]
    cons, sign = dict(zip(script._CONSONANTS, consonants)), dict(zip(script._SIGNS[1:], vowels[1:]))
    letters = dict(zip(script._VOWELS, vowels)) | dict(zip(script._MARKS, marks)) | {chr(0x0966 + i): str(i) for i in range(10)} | cons | sign | {script.VIRAMA: ""}
    bearing, ending = _quoted("".join(cons)), _quoted("".join(sign) + script.VIRAMA)
    chars = f"regexp_extract_all({x}, '(?s).')"
    piece = f"CASE WHEN i > 1 AND contains({bearing}, c[i - 1]) AND NOT contains({ending}, ch) THEN 'a' ELSE '' END || coalesce({_map(letters)}[ch], ch)"
    return f"(SELECT array_to_string(list_transform(c, lambda ch, i: {piece}), '') || CASE WHEN contains({bearing}, c[len(c)]) THEN 'a' ELSE '' END FROM (SELECT {chars} AS c))"


def _read(scheme: str, x: str) -> str:
    """A Roman scheme in Devanagari, by the longest letters: a vowel after a consonant is a sign, anything else a virama."""
    vowels, consonants, marks = script._ROMAN[scheme]
    also = script._ALIASES.get(scheme, {})
    named = lambda roman, deva_: dict(zip(roman, deva_)) | {k: dict(zip(roman, deva_))[r] for k, r in also.items() if r in roman}
    whole, sign, cons, mark = named(vowels, script._VOWELS), named(vowels, script._SIGNS), named(consonants, script._CONSONANTS), named(marks, script._MARKS)
    letters = sorted({*whole, *cons, *mark}, key=len, reverse=True)
    tokens = f"regexp_extract_all({x}, {_quoted('(?s)' + '|'.join(map(re.escape, letters)) + '|.')})"
    after = f"i > 1 AND map_contains({_map(cons)}, c[i - 1])"
    vowel = f"CASE WHEN {after} THEN {_map(sign)}[ch] ELSE {_map(whole)}[ch] END"
    other = f"CASE WHEN {after} THEN '{script.VIRAMA}' ELSE '' END || coalesce({_map(cons | mark)}[ch], ch)"
    piece = f"CASE WHEN map_contains({_map(whole)}, ch) THEN {vowel} ELSE {other} END"
    return f"(SELECT array_to_string(list_transform(c, lambda ch, i: {piece}), '') || CASE WHEN map_contains({_map(cons)}, c[len(c)]) THEN '{script.VIRAMA}' ELSE '' END FROM (SELECT {tokens} AS c))"


@query(f"WITH x AS (SELECT item_id, text, {_deva('text')} AS dev FROM benchmark WHERE length(text) > 0) " + " UNION ALL ".join(f"SELECT item_id, '{s}' AS scheme, {_written(s, 'dev')} AS written, {_read(s, 'text')} AS read FROM x" for s in SCHEMES))
def roman_schemes(spark, d):
    """Items in Devanagari written in each Roman scheme, and their Latin text read as if in it."""
    x = t(spark, d, "benchmark").where("length(text) > 0").select("item_id", "text", deva(F.col("text")).alias("dev"))
    each = [F.struct(F.lit(s).alias("scheme"), script.transliterate(F.col("dev"), "devanagari", s).alias("written"), script.transliterate(F.col("text"), s).alias("read")) for s in SCHEMES]
    return x.select("item_id", F.inline(F.array(*each)))


# ------------------------------------------------------------------ SQL of earlier queries


def _add(name: str, sql: str) -> None:
    assert name in QUERIES
    SQL[name] = sql


_add(
    "band_report",
    f"WITH {_PAIRS}, c AS (SELECT conv_id, conv_id || '-' || turn AS key, cl AS score, ce / cl::DOUBLE AS dis FROM e WHERE cl > 0) "
    "SELECT 'hardest' AS part, key, dis AS value FROM (SELECT * FROM c ORDER BY score DESC, key LIMIT 6) UNION ALL SELECT 'band', key, dis FROM (SELECT * FROM c WHERE dis BETWEEN 0.7 AND 0.75 ORDER BY key LIMIT 3) "
    "UNION ALL SELECT 'total', 'excluded', count(*) FILTER (dis > 0.9)::DOUBLE FROM c UNION ALL SELECT 'total', 'per_group', count(*) / count(DISTINCT conv_id)::DOUBLE FROM c",
)
_add(
    "spread_topn",
    "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, start) AS n FROM (SELECT user_id, floor(epoch(ts))::DOUBLE AS start, value FROM events)), "
    "s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::DOUBLE[] AS starts, []::DOUBLE[] AS vals, []::DOUBLE[] AS lstarts, []::DOUBLE[] AS lvals FROM e "
    "UNION ALL SELECT user_id, n, CASE WHEN ok THEN starts || [start] ELSE starts END, CASE WHEN ok THEN vals || [value] ELSE vals END, CASE WHEN back THEN lstarts || [start] ELSE lstarts END, CASE WHEN back THEN lvals || [value] ELSE lvals END FROM ("
    "SELECT *, NOT ok AND NOT twin AND len(lstarts) < 20 AND len(starts) < 20 AS back FROM (SELECT s.user_id, e.n, starts, vals, lstarts, lvals, start, value, len(starts) < 20 AND coalesce(list_min(list_transform(starts, lambda y: abs(y - start))) >= 86400, true) AS ok, "
    "len(list_filter(starts, lambda y, i: y = start AND vals[i] = value)) > 0 AS twin FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))), "
    "f AS (SELECT user_id, starts || lstarts AS a, vals || lvals AS v, len(starts) AS c FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1) "
    "SELECT user_id, (i - 1)::INT AS pick, a[i] AS start, v[i] AS value, i > c AS backfill FROM (SELECT *, unnest(range(1, least(len(a), 20) + 1)) AS i FROM f)",
)

_TURNS = f"""tu AS (SELECT conv_id, turn, {_LATIN.format(c='text')} AS ref FROM conversations),
tp AS (SELECT {{'c': conv_id, 't': turn}} AS id, {_WORDS.format(c='ref')} AS a, {_WORDS.format(c='hyp')} AS b FROM (SELECT *, lead(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM tu) WHERE hyp IS NOT NULL)"""
_add(
    "agreeing_runs",
    f"WITH RECURSIVE {_TURNS}, {blocks_sql('SELECT id, a, b FROM tp')} SELECT id.c AS conv_id, id.t AS turn, i::INT AS start, (i + k)::INT AS \"end\" FROM mb WHERE k >= 3",
)
_add(
    "gated_runs",
    f"WITH RECURSIVE {_TURNS}, {blocks_sql('SELECT id, a, b FROM tp')}, lx AS (SELECT w FROM (SELECT unnest({_WORDS.format(c=_LATIN.format(c='text'))}) AS w FROM documents) GROUP BY w HAVING count(*) >= 5), "
    "r AS (SELECT id, i AS start, i + k AS end_, len(a) AS n, a[i + 1:i + k] AS run FROM mb JOIN pb USING (id) WHERE k >= 3), "
    "y AS (SELECT id, start, end_, n, array_to_string(run, ' ') AS text, count(lx.w) / count(*)::DOUBLE AS share FROM (SELECT *, unnest(run) AS w FROM r) LEFT JOIN lx USING (w) GROUP BY ALL), "
    "z AS (SELECT *, greatest(start * 0.4::DOUBLE - 0.1::DOUBLE, 0) AS from_s, least(end_ * 0.4::DOUBLE + 0.1::DOUBLE, n * 0.4::DOUBLE) AS to_s FROM y) "
    "SELECT id.c AS conv_id, id.t AS turn, start::INT AS start, end_::INT AS \"end\", text, share AS corpus_share, from_s, to_s FROM z WHERE share >= 0.6 AND to_s - from_s BETWEEN 1 AND 18",
)
_CW = f"c AS (SELECT conv_id, turn, {_WORDS.format(c=_LATIN.format(c='text'))} AS w FROM conversations), cw AS (SELECT conv_id, turn, w, k, coalesce(lead(w, k) OVER (PARTITION BY conv_id, k ORDER BY turn), []) AS h FROM c, (SELECT unnest([1, 2, 3]) AS k))"
_TURN_ID = "{'c': conv_id, 't': turn, 'k': k}"
_add(
    "consensus_bands",
    f"WITH RECURSIVE {_CW}, {trace_sql('SELECT ' + _TURN_ID + ' AS id, w AS r, h FROM cw WHERE len(w) > 0')}, "
    "u AS (SELECT id.c AS c, id.t AS t, ri, list(op ORDER BY id.k) AS ops, list(CASE WHEN op = 'S' THEN hc ELSE '' END ORDER BY id.k) AS heard FROM op WHERE op <> 'I' GROUP BY ALL), "
    "z AS (SELECT len(list_filter(ops, lambda o: o = 'M')) AS hits, len(list_filter(ops, lambda o: o = 'S')) AS subs, len(list_distinct(heard)) AS kinds FROM u) "
    "SELECT CASE hits WHEN 3 THEN 'green' WHEN 0 THEN 'red' ELSE 'amber' END AS strict, CASE WHEN hits > 0 THEN 'green' WHEN subs = 3 AND kinds = 1 THEN 'red' ELSE 'amber' END AS liberal, count(*) AS n FROM z GROUP BY ALL",
)
