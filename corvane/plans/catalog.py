"""Registered queries over the driver's tables.  Each runs over whole tables and whole texts; DuckDB SQL is given where
SQL can express the query at a bearable cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import align, script
from corvane.functions.edit import char_edits, word_disagreement
from corvane.functions.text import cache_key, char_tokens, degenerate, first_rule, html_text, low_variety, norm, words
from corvane.operators import curate, fusion, lexicon, metrics, posterior, sequence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn (ref) with the next turn of its conversation (hyp), all letters of both."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", latin("text").alias("ref"))
    return c.withColumn("hyp", F.lead("ref").over(Window.partitionBy("conv_id").orderBy("turn"))).where("hyp is not null")


_LATIN = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = "list_filter(string_split({c}, ' '), lambda w: w <> '')"
#: DuckDB measures edits in bytes: letters beyond ASCII become ASCII characters that normalised text does not have.
_ONE_BYTE = """sy AS (SELECT coalesce(string_agg(x, '' ORDER BY x), '') AS src FROM (SELECT DISTINCT unnest(string_split({norm}, '')) AS x FROM {table}) WHERE x > '~'),
enc AS (SELECT src, substr('0123456789!#$%&()*+,-./:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^_{{|}}~', 1, length(src)) AS dst FROM sy)"""
_PAIRS = f"""{_ONE_BYTE.format(norm=_LATIN.format(c="text"), table="conversations")},
p AS (SELECT * FROM (SELECT conv_id, turn, role, ref, lead(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp
  FROM (SELECT conv_id, turn, role, {_LATIN.format(c="text")} AS ref FROM conversations)) WHERE hyp IS NOT NULL),
e AS (SELECT p.*, levenshtein(translate(replace(ref, ' ', ''), src, dst), translate(replace(hyp, ' ', ''), src, dst)) AS ce, length(replace(ref, ' ', '')) AS cl FROM p, enc)"""

#: Word alignments as SQL: each row of the distance table is a running minimum, and the trace goes from the end.
_TRACE = f"""p AS (SELECT conv_id, turn, role, ref, hyp, {_WORDS.format(c='ref')} AS r, {_WORDS.format(c='hyp')} AS h FROM (
  SELECT conv_id, turn, role, ref, lead(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM (SELECT conv_id, turn, role, {_LATIN.format(c="text")} AS ref FROM conversations)) WHERE hyp IS NOT NULL),
dp AS (SELECT conv_id, turn, 0 AS i, range(0, len(h) + 1)::INT[] AS d FROM p
  UNION ALL SELECT conv_id, turn, i + 1, list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(u[1:j], lambda x, k: x - k)) + j)::INT[] FROM (
    SELECT dp.*, h, [i + 1] || list_transform(range(1, len(h) + 1), lambda j: least(d[j + 1] + 1, d[j] + (r[i + 1] <> h[j])::INT)) AS u FROM dp JOIN p USING (conv_id, turn) WHERE i < len(r)) dp),
wd AS (SELECT conv_id, turn, d[len(d)] AS we FROM dp JOIN p USING (conv_id, turn) WHERE i = len(r)),
tr AS (SELECT conv_id, turn, len(r)::INT AS i, len(h)::INT AS j, NULL::VARCHAR AS op, 0 AS ri, 0 AS hi FROM p
  UNION ALL SELECT conv_id, turn, CASE WHEN o = 'I' THEN i ELSE i - 1 END, CASE WHEN o = 'D' THEN j ELSE j - 1 END, o, i - 1, CASE WHEN o = 'D' THEN -1 ELSE j - 1 END FROM (
    SELECT tr.conv_id, tr.turn, tr.i, tr.j, CASE WHEN tr.i > 0 AND tr.j > 0 AND r[tr.i] = h[tr.j] THEN 'M' WHEN tr.i > 0 AND tr.j > 0 AND a.d[tr.j + 1] = b.d[tr.j] + 1 THEN 'S' WHEN tr.i > 0 AND a.d[tr.j + 1] = b.d[tr.j + 1] + 1 THEN 'D' ELSE 'I' END AS o
    FROM tr JOIN p USING (conv_id, turn) JOIN dp a ON a.conv_id = tr.conv_id AND a.turn = tr.turn AND a.i = tr.i LEFT JOIN dp b ON b.conv_id = tr.conv_id AND b.turn = tr.turn AND b.i = tr.i - 1 WHERE tr.i + tr.j > 0)),
ops AS (SELECT p.role, tr.conv_id, tr.turn, op, ri, hi, CASE WHEN op <> 'I' THEN r[ri + 1] END AS rc, CASE WHEN op <> 'D' THEN h[hi + 1] END AS hc FROM tr JOIN p USING (conv_id, turn) WHERE op IS NOT NULL)"""


def latin(c: str):
    return norm(F.col(c), "latin", compose=False)


def char_pairs(spark: SparkSession, d: str) -> DataFrame:
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return turn_pairs(spark, d).withColumns({"ce": char_edits(bare("ref"), bare("hyp")), "cl": F.length(bare("ref"))})


# ------------------------------------------------------------------ text


@query("SELECT doc_id, " + _LATIN.format(c="nfc_normalize(text)") + " AS norm FROM documents")
def norm_latin(spark, d):
    return t(spark, d, "documents").select("doc_id", norm(F.col("text"), "latin").alias("norm"))


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\v\x{a0}]+', ' ', 'g')) AS text FROM pages".replace('\\"', '"'))
def html_to_text(spark, d):
    return t(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


URL_RULES = [("https://www.", "secure_www"), ("https://blog.", "blog"), ("http://blog.", "blog"), ("https://m.", "mobile"), ("http://m.", "mobile"), ("https://", "secure")]


@query("SELECT tag, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN starts_with(url, '{p}') THEN '{g}'" for p, g in URL_RULES) + " ELSE 'plain' END AS tag FROM pages) GROUP BY tag")
def url_rules(spark, d):
    return t(spark, d, "pages").select(first_rule(F.col("url"), URL_RULES, default="plain").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE coalesce(len(list_distinct(string_split(replace(text, ' ', ''), ''))) / nullif(length(replace(text, ' ', '')), 0)::DOUBLE < 0.03, true)")
def low_variety_docs(spark, d):
    return t(spark, d, "documents").where(low_variety(F.col("text"), 0.03)).select("doc_id")


@query(
    "WITH w AS (SELECT doc_id, " + _WORDS.format(c=_LATIN.format(c="text")) + " AS w FROM documents), "
    "g AS (SELECT doc_id, w, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w WHERE len(w) >= 8 AND len(list_distinct(w)) < 0.5 * len(w)) "
    "SELECT doc_id FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g) GROUP BY doc_id HAVING max(n) >= 3"
)
def degenerate_docs(spark, d):
    return t(spark, d, "documents").select("doc_id", words(latin("text")).alias("w")).where(degenerate(F.col("w"))).select("doc_id")


@query("SELECT CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'iast' ELSE 'devanagari' END AS script, count(*) AS n FROM documents GROUP BY 1")
def scripts(spark, d):
    return t(spark, d, "documents").select(script.detect_script(F.col("text")).alias("script")).groupBy("script").agg(F.count("*").alias("n"))


@query("SELECT doc_id, substr(sha1(concat_ws('|', text, lang, '60')), 1, 16) AS key FROM documents")
def cache_keys(spark, d):
    return t(spark, d, "documents").select("doc_id", cache_key(F.col("text"), F.col("lang"), F.lit("60")).alias("key"))


@query("SELECT item_id, array_to_string(list_transform(" + _WORDS.format(c=_LATIN.format(c="text")) + ", lambda w: array_to_string(string_split(w, ''), ' ')), ' | ') AS tokens FROM benchmark")
def char_lm_tokens(spark, d):
    return t(spark, d, "benchmark").select("item_id", char_tokens(latin("text")).alias("tokens"))


@query("SELECT symbol, row_number() OVER (ORDER BY encode(symbol)) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS symbol FROM benchmark) WHERE symbol <> ''")
def char_vocabulary(spark, d):
    return sequence.numbering(t(spark, d, "benchmark"), "text")


# ------------------------------------------------------------------ metrics


@query(f"WITH {_PAIRS} SELECT role, count(*) AS n, sum(ce)::BIGINT AS char_edits, sum(cl)::BIGINT AS char_len, sum(ce)::DOUBLE / nullif(sum(cl), 0) AS cer FROM e GROUP BY ROLLUP (role)")
def micro_cer(spark, d):
    sums = char_pairs(spark, d).rollup("role").agg(F.count("*").alias("n"), F.sum("ce").alias("char_edits"), F.sum("cl").alias("char_len"))
    return sums.withColumn("cer", F.try_divide("char_edits", "char_len"))


@query(
    f"WITH RECURSIVE {_ONE_BYTE.format(norm=_LATIN.format(c='text'), table='conversations')}, {_TRACE}, e AS (SELECT role, we, len(r) AS wl, levenshtein(translate(replace(ref, ' ', ''), src, dst), translate(replace(hyp, ' ', ''), src, dst)) AS ce, length(replace(ref, ' ', '')) AS cl FROM p JOIN wd USING (conv_id, turn), enc) "
    "SELECT role, count(*) AS n, sum(ce)::BIGINT AS char_edits, sum(cl)::BIGINT AS char_len, sum(we)::BIGINT AS word_edits, sum(wl)::BIGINT AS word_len, sum(ce) / nullif(sum(cl), 0)::DOUBLE AS cer, sum(we) / nullif(sum(wl), 0)::DOUBLE AS wer FROM e GROUP BY ROLLUP (role)"
)
def micro_wer(spark, d):
    return metrics.rollup_micro(metrics.with_edits(turn_pairs(spark, d)), "role")


@query(f"WITH {_PAIRS} SELECT {', '.join(f'quantile_cont(ce / cl::DOUBLE, {x / 100}) AS p{x}' for x in (10, 25, 50, 75, 90, 95, 99))}, avg(ce / cl::DOUBLE) AS mean FROM e WHERE cl > 0")
def cer_percentiles(spark, d):
    return metrics.percentiles(char_pairs(spark, d).where("cl > 0").withColumn("cer", F.col("ce") / F.col("cl")), "cer")


_EDGES = (0.0, 0.5, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0, 5.0)


@query(f"WITH {_PAIRS} SELECT lower, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN ce / cl::DOUBLE >= {x} THEN {x}::DOUBLE" for x in reversed(_EDGES)) + " END AS lower FROM e WHERE cl > 0) GROUP BY lower")
def cer_histogram(spark, d):
    return metrics.histogram(char_pairs(spark, d).where("cl > 0").withColumn("cer", F.col("ce") / F.col("cl")), "cer", _EDGES)


@query(f"WITH {_PAIRS} SELECT CASE WHEN cl >= 1000 THEN 1000.0::DOUBLE WHEN cl >= 600 THEN 600.0::DOUBLE WHEN cl >= 300 THEN 300.0::DOUBLE ELSE 0.0::DOUBLE END AS bucket, count(*) AS n, sum(ce)::DOUBLE / sum(cl) AS cer FROM e WHERE cl > 0 GROUP BY 1")
def error_by_length(spark, d):
    p = char_pairs(spark, d).where("cl > 0").withColumn("bucket", metrics.bucket(F.col("cl"), (0, 300, 600, 1000)))
    return p.groupBy("bucket").agg(F.count("*").alias("n"), (F.sum("ce") / F.sum("cl")).alias("cer"))


@query(
    f"WITH {_PAIRS}, g AS (SELECT conv_id, sum(ce)::DOUBLE / sum(cl) AS cer FROM e GROUP BY conv_id HAVING sum(cl) > 0) "
    "SELECT * FROM (SELECT conv_id, cer, 'worst' AS side FROM g ORDER BY cer DESC, conv_id LIMIT 6) UNION ALL SELECT * FROM (SELECT conv_id, cer, 'best' AS side FROM g ORDER BY cer, conv_id LIMIT 4)"
)
def best_and_worst_conversations(spark, d):
    g = char_pairs(spark, d).groupBy("conv_id").agg(F.sum("ce").alias("ce"), F.sum("cl").alias("cl")).where("cl > 0")
    return metrics.best_and_worst(g.select("conv_id", (F.col("ce") / F.col("cl")).alias("cer")), "cer", "conv_id")


def systems(spark, d) -> DataFrame:
    """Three stand-in systems for each turn: the next turn, the one after, and the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, d, "conversations").select("conv_id", "turn", F.replace(latin("text"), F.lit(" "), F.lit("")).alias("ref"))
    c = c.withColumns({"h1": F.lead("ref", 1).over(w), "h2": F.lead("ref", 2).over(w), "h3": F.lag("ref", 1).over(w)}).where("h1 is not null and h2 is not null and h3 is not null")
    return c.withColumns({f"e{i}": char_edits(F.col("ref"), F.col(f"h{i}")) for i in (1, 2, 3)}).withColumn("n", F.length("ref"))


_SYSTEMS = f"""{_ONE_BYTE.format(norm=_LATIN.format(c="text"), table="conversations")},
s AS (SELECT *, levenshtein(ref, h1) AS e1, levenshtein(ref, h2) AS e2, levenshtein(ref, h3) AS e3, length(ref) AS n FROM (
  SELECT conv_id, turn, ref, lead(ref, 1) OVER w AS h1, lead(ref, 2) OVER w AS h2, lag(ref, 1) OVER w AS h3
  FROM (SELECT conv_id, turn, translate(replace({_LATIN.format(c="text")}, ' ', ''), src, dst) AS ref FROM conversations, enc) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE h1 IS NOT NULL AND h2 IS NOT NULL AND h3 IS NOT NULL)"""


@query(f"WITH {_SYSTEMS} SELECT sum(e1) / sum(n)::DOUBLE AS e1, sum(e2) / sum(n)::DOUBLE AS e2, sum(e3) / sum(n)::DOUBLE AS e3, sum(least(e1, e2, e3)) / sum(n)::DOUBLE AS oracle FROM s")
def oracle_min(spark, d):
    return metrics.oracle(systems(spark, d), ["e1", "e2", "e3"], "n")


@query(f"WITH {_SYSTEMS} SELECT count(*) FILTER (e1 < e2) AS a_wins, count(*) FILTER (e1 > e2) AS b_wins, count(*) FILTER (e1 = e2) AS ties, count(*) FILTER (e1 = 0 AND e2 = 0) AS both_perfect FROM s")
def win_tie(spark, d):
    return metrics.wins(systems(spark, d), "e1", "e2")


@query()
def rover_vote(spark, d):
    s = systems(spark, d)
    voted = fusion.rover(F.col("h1"), F.col("h2"), F.col("h3"))
    return s.select("conv_id", "turn", voted.alias("voted")).groupBy().agg(F.count("*").alias("n"), F.sum(F.length("voted")).alias("chars"), F.bit_xor(F.crc32("voted")).alias("digest"))


@query()
def sn_wer(spark, d):
    return metrics.sn_wer(turn_pairs(spark, d), "role")


@query(f"WITH RECURSIVE {_TRACE} SELECT role, least(ri, 7)::INT AS position, count(*) AS n, sum((op <> 'M')::INT)::BIGINT AS errors, errors / n AS rate FROM ops WHERE op <> 'I' GROUP BY role, position")
def position_error(spark, d):
    return metrics.position_errors(turn_pairs(spark, d), "role")


@query(
    f"WITH RECURSIVE {_ONE_BYTE.format(norm=_LATIN.format(c='text'), table='conversations')}, {_TRACE} SELECT role, count(*) AS n, avg((op = 'M')::INT) AS word_accuracy, "
    "avg((op = 'M' OR op = 'S' AND levenshtein(translate(rc, src, dst), translate(hc, src, dst)) <= 1)::INT) AS within_one FROM ops, enc WHERE op <> 'I' GROUP BY role"
)
def word_accuracy(spark, d):
    return metrics.word_accuracy(turn_pairs(spark, d), "role")


@query()
def confusions_topk(spark, d):
    return metrics.top(metrics.confusions(metrics.char_ops(turn_pairs(spark, d))), 10, F.desc("count"), "op", "rc", "hc")


@query()
def edit_breakdown(spark, d):
    return metrics.breakdown(turn_pairs(spark, d))


@query()
def vowel_recall(spark, d):
    return metrics.family_recall(metrics.char_ops(turn_pairs(spark, d), "role"), "aeiou", "role")


@query(
    f"WITH RECURSIVE {_TRACE}, s AS (SELECT rc, hc, list_filter(range(1, length(rc) + 1), lambda i: substr(rc, i, 1) <> substr(hc, i, 1)) AS spots FROM ops WHERE op = 'S' AND length(rc) = length(hc)) "
    "SELECT substr(rc, spots[1], 1) AS rc, substr(hc, spots[1], 1) AS hc, count(*) AS n FROM s WHERE len(spots) = 1 GROUP BY ALL"
)
def single_char_substitutions(spark, d):
    return metrics.single_substitutions(turn_pairs(spark, d))


_THIN = "coalesce(len(list_distinct(string_split(replace(hyp, ' ', ''), ''))) / nullif(length(replace(hyp, ' ', '')), 0)::DOUBLE < 0.3, true)"


@query(f"WITH RECURSIVE {_TRACE}, x AS (SELECT conv_id, turn, hyp, we / greatest(len(r), len(h), 1)::DOUBLE AS dis FROM p JOIN wd USING (conv_id, turn)) SELECT conv_id, turn, dis FROM x WHERE dis <= 0.97 AND NOT {_THIN}")
def disagreement_band(spark, d):
    p = turn_pairs(spark, d).withColumn("dis", word_disagreement(F.col("ref"), F.col("hyp")))
    return curate.disagreement_band(p, "dis", "hyp", most=0.97).select("conv_id", "turn", "dis")


@query()
def consensus_bands(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, d, "conversations").select("conv_id", "turn", words(latin("text")).alias("ref"))
    c = c.withColumns({f"h{i}": F.coalesce(F.lead("ref", i).over(w), F.array().cast("array<string>")) for i in (1, 2, 3)})
    c = c.where(F.size("ref") > 0).withColumn("ops", fusion.consensus(F.col("ref"), [F.col("h1"), F.col("h2"), F.col("h3")]))
    units = c.select("conv_id", F.explode("ops").alias("o"))
    strict, liberal = fusion.bands(F.col("o"))
    u = units.select("conv_id", strict.alias("strict"), liberal.alias("liberal"))
    return u.groupBy("strict", "liberal").agg(F.count("*").alias("n"))


@query()
def anchored_turns(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", latin("text").alias("s"))
    whole = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]))  # the turns of one conversation
    ref = c.groupBy("conv_id").agg(whole.alias("ref"))
    return metrics.anchored(c.where("role = 'assistant'"), ref, "conv_id", "turn", "s", "ref")


@query()
def agreeing_runs(spark, d):
    p = turn_pairs(spark, d)
    return p.select("conv_id", "turn", F.explode(fusion.agreeing_runs(F.col("ref"), F.col("hyp"))).alias("r")).select("conv_id", "turn", "r.*")


@query()
def match_ratios(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", align.match_ratio("ref", "hyp").alias("ratio"))


@query()
def band_report(spark, d):
    p = char_pairs(spark, d).where("cl > 0").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("cl").alias("score"), (F.col("ce") / F.col("cl")).alias("dis"))
    return curate.band_report(p, "conv_id", "score", "dis", "key", lo=0.7, hi=0.75)


_LABELLED = "l AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1))"


@query(
    f"WITH {_LABELLED}, r AS (SELECT quality, row_number() OVER (ORDER BY n_chars, quality DESC) - 1 AS r FROM l), "
    "s AS (SELECT sum(r) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM r) "
    "SELECT (r - p * (p - 1) / 2) / (p * n)::DOUBLE AS auc, p AS positives, n AS negatives FROM s"
)
def auc_rank(spark, d):
    l = t(spark, d, "documents").join(t(spark, d, "labels").where("quality in (0, 1)"), "doc_id")
    return metrics.auc(l, "n_chars", "quality", "doc_id")


@query(f"WITH {_LABELLED}, c AS (SELECT quantile_cont(n_chars, 0.05) AS threshold FROM l WHERE quality = 0) SELECT threshold::DOUBLE AS threshold, avg(CASE WHEN quality = 1 THEN (n_chars < threshold)::INT END) AS recall, avg(CASE WHEN quality = 0 THEN (n_chars < threshold)::INT END) AS fpr FROM l, c GROUP BY threshold")
def fpr_threshold(spark, d):
    l = t(spark, d, "documents").join(t(spark, d, "labels").where("quality in (0, 1)"), "doc_id")
    return metrics.threshold_at_fpr(l, "n_chars", "quality", 0.05)


# ------------------------------------------------------------------ lexicon


def corpus_words(spark, d, name="documents", *keep):
    return lexicon.tokens(t(spark, d, name), latin("text"), *keep)


def main_lexicon(spark, d) -> DataFrame:
    return lexicon.weighted(corpus_words(spark, d), corpus_words(spark, d, "benchmark").distinct())


def oov_rates(spark, d) -> DataFrame:
    """Of each document, under the lexicon of all."""
    return lexicon.oov_once(t(spark, d, "documents"), "doc_id", latin("text"), corpus_words(spark, d, "benchmark").distinct())


_TOKENS = "tok AS (SELECT doc_id, lang, unnest(" + _WORDS.format(c=_LATIN.format(c="text")) + ") AS word FROM documents)"
_GLOSS = "gl AS (SELECT DISTINCT unnest(" + _WORDS.format(c=_LATIN.format(c="text")) + ") AS word FROM benchmark)"
_LEX = f"{_TOKENS}, {_GLOSS}, lex AS (SELECT word, sum(n)::BIGINT AS freq FROM (SELECT word, 1 AS n FROM tok UNION ALL SELECT word, 50 FROM gl) GROUP BY word HAVING sum(n) >= 2)"


@query(f"WITH {_TOKENS} SELECT lang, word, count(*) AS freq FROM tok WHERE length(word) >= 2 GROUP BY ALL")
def lexicon_by_tag(spark, d):
    return lexicon.by_tag(t(spark, d, "documents"), "lang", latin("text"))


@query(f"WITH {_TOKENS}, f AS (SELECT lang, count(*) AS files FROM documents GROUP BY lang), x AS (SELECT lang, count(*) AS tokens, count(DISTINCT word) AS types FROM tok WHERE length(word) >= 2 GROUP BY lang) SELECT f.lang, files, coalesce(tokens, 0) AS tokens, coalesce(types, 0) AS types FROM f LEFT JOIN x ON f.lang IS NOT DISTINCT FROM x.lang")
def lexicon_summary(spark, d):
    return lexicon.tag_summary(t(spark, d, "documents"), "lang", latin("text"))


@query(f"WITH {_LEX} SELECT word, freq FROM lex")
def lexicon_weighted(spark, d):
    return main_lexicon(spark, d)


@query(f"WITH {_LEX} SELECT doc_id, count(*) AS tokens, sum(CASE WHEN lex.word IS NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE AS oov_rate FROM tok LEFT JOIN lex USING (word) GROUP BY doc_id")
def oov_rate(spark, d):
    return oov_rates(spark, d)


_BENCH = f"""{_TOKENS}, {_GLOSS}, {_ONE_BYTE.format(norm="word", table="(SELECT word FROM tok UNION ALL SELECT word FROM gl)")},
lx AS (SELECT word, count(*) AS freq, translate(word, any_value(src), any_value(dst)) AS code FROM tok, enc GROUP BY word HAVING count(*) >= 2), b AS (SELECT word, translate(word, src, dst) AS code FROM gl, enc)"""


def bench_words(spark, d):
    """Distinct words of the benchmark, and the corpus lexicon of words seen twice or more."""
    left = corpus_words(spark, d, "benchmark").distinct()
    return left, corpus_words(spark, d).groupBy("word").agg(F.count("*").alias("freq")).where("freq >= 2")


_NEAR = f"WITH {_BENCH}, c AS (SELECT b.word, lx.word AS cand, freq, levenshtein(b.code, lx.code) AS dist FROM b JOIN lx ON abs(length(b.word) - length(lx.word)) <= 2 AND b.word <> lx.word) "


@query(_NEAR + "SELECT word, cand, freq, dist FROM c WHERE dist <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, cand) <= 5")
def fuzzy_candidates(spark, d):
    return lexicon.fuzzy(*bench_words(spark, d))


@query(f"WITH {_BENCH} SELECT b.word, lx.word AS cand, freq FROM b JOIN lx ON abs(length(b.word) - length(lx.word)) <= 1 AND b.word <> lx.word WHERE damerau_levenshtein(b.code, lx.code) = 1")
def edit_one_candidates(spark, d):
    return lexicon.edit_one(*bench_words(spark, d))


@query(
    f"WITH {_BENCH}, h AS (SELECT word, cut, substr(word, 1, cut) AS head, substr(word, cut + 1) AS tail FROM (SELECT word, unnest(range(2, length(word) - 1)) AS cut FROM b WHERE length(word) >= 6)) "
    "SELECT h.word, head AS first, tail AS second, x.freq + y.freq AS freq FROM h JOIN lx x ON x.word = h.head JOIN lx y ON y.word = h.tail QUALIFY row_number() OVER (PARTITION BY h.word ORDER BY x.freq + y.freq DESC, cut) = 1"
)
def split_candidates(spark, d):
    return lexicon.splits(*bench_words(spark, d))


@query(_NEAR + "SELECT word, cand AS projected FROM c WHERE dist <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, cand) = 1")
def blind_projection(spark, d):
    return fusion.project_blind(lexicon.fuzzy(*bench_words(spark, d), k=None))


@query(
    # every split of a word into known pieces, and the one with the largest sum of log frequencies less a penalty each
    f"WITH RECURSIVE {_BENCH}, n AS (SELECT sum(freq) AS n FROM lx WHERE length(word) BETWEEN 2 AND 22), k AS (SELECT word, ln(freq / n::DOUBLE) - 6 AS gain FROM lx, n WHERE length(word) BETWEEN 2 AND 22), "
    "s AS (SELECT word, 0 AS pos, 0.0::DOUBLE AS score, []::VARCHAR[] AS pieces, []::INT[] AS cuts FROM b WHERE length(word) >= 6 AND word NOT IN (SELECT word FROM k) "
    "UNION ALL SELECT s.word, s.pos + length(k.word), s.score + k.gain, list_append(s.pieces, k.word), [s.pos::INT] || s.cuts FROM s JOIN k ON substr(s.word, s.pos + 1, length(k.word)) = k.word), "
    "f AS (SELECT word, pieces FROM s WHERE pos = length(word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY round(score, 6) DESC, cuts) = 1) "
    "SELECT b.word, coalesce(f.pieces, [b.word]) AS pieces FROM b LEFT JOIN f USING (word)"
)
def dictionary_tiling(spark, d):
    left, lx = bench_words(spark, d)
    return lexicon.tiled(left, "word", lx.where("length(word) between 2 and 22"))


@query(f"WITH {_LEX}, b AS (SELECT word FROM gl), l AS (SELECT word FROM lex) SELECT (SELECT count(*) FROM (SELECT word FROM b INTERSECT SELECT word FROM l)) AS both, (SELECT count(*) FROM (SELECT word FROM b EXCEPT SELECT word FROM tok)) AS new, (SELECT count(*) FROM (SELECT word FROM b UNION SELECT word FROM l)) AS any")
def word_sets(spark, d):
    b, l, tok = corpus_words(spark, d, "benchmark").distinct(), main_lexicon(spark, d).select("word"), corpus_words(spark, d)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(b.join(l, "word", "left_semi"), "both").crossJoin(n(b.join(tok, "word", "left_anti"), "new")).crossJoin(n(b.union(l).distinct(), "any"))


@query(
    f"WITH RECURSIVE {_BENCH}, {_TRACE}, wr AS (SELECT DISTINCT w.word, translate(w.word, src, dst) AS code FROM (SELECT unnest(h) AS word FROM p) w, enc), "
    "c AS (SELECT wr.word, lx.word AS cand FROM wr JOIN lx ON abs(length(wr.word) - length(lx.word)) <= 2 AND wr.word <> lx.word WHERE levenshtein(wr.code, lx.code) <= 2 QUALIFY row_number() OVER (PARTITION BY wr.word ORDER BY levenshtein(wr.code, lx.code), freq DESC, lx.word) <= 5) "
    "SELECT count(*) AS n, count(*) FILTER (op = 'M') AS correct, count(*) FILTER (op <> 'M' AND (hc, rc) IN (SELECT (word, cand) FROM c)) AS recoverable, count(*) FILTER (rc IN (SELECT word FROM lx)) AS in_lexicon FROM ops WHERE op <> 'I'"
)
def recoverable_words(spark, d):
    left, lx = bench_words(spark, d)
    pairs = turn_pairs(spark, d)
    return lexicon.recoverability(pairs, lexicon.fuzzy(lexicon.near_misses(pairs), lx), lx)


# ------------------------------------------------------------------ curation


@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(spark, d):
    return curate.last_write_wins(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT doc_id, source, n_chars, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5")
def topn_per_group(spark, d):
    return curate.top_per_group(t(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", 5, F.desc("n_chars"), F.col("doc_id"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, greatest(count(*) OVER (PARTITION BY source) // 12, 1) AS s FROM documents) SELECT doc_id, source, rn FROM r WHERE (rn - 1) % s = 0 AND (rn - 1) // s < 12")
def systematic_sample(spark, d):
    return curate.systematic(t(spark, d, "documents").select("doc_id", "source"), "source", 12, "doc_id")


@query("SELECT doc_id, n_chars, before FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before < 200000")
def budget_prefix(spark, d):
    return curate.budget_prefix(t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 200_000, "doc_id")


@query(
    "WITH g AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source), "
    "r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents), "
    "s AS (SELECT r.*, coalesce(sum(n_chars) OVER (ORDER BY turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source) SELECT * FROM s WHERE before < 200000"
)
def round_robin_budget(spark, d):
    return curate.round_robin(t(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars", 200_000, "doc_id")


@query(
    "WITH d AS (SELECT *, CASE lang WHEN 'de' THEN 0.0 WHEN 'fr' THEN 100000.0 ELSE 150000.0 END AS cap FROM documents), "
    "g AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS place FROM d GROUP BY lang, source), "
    "r AS (SELECT doc_id, lang, source, n_chars, cap, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM d WHERE cap > 0), "
    "s AS (SELECT r.*, coalesce(sum(n_chars) OVER (PARTITION BY r.lang ORDER BY turn, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source) "
    "SELECT doc_id, lang, source, n_chars, 'train' AS split FROM s WHERE before < cap UNION ALL SELECT doc_id, lang, source, n_chars, 'eval' FROM d WHERE cap = 0"
)
def language_caps(spark, d):
    return curate.per_group_caps(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "lang", "source", "n_chars", {"de": 0, "fr": 100_000}, 150_000, "doc_id")


@query("SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 10007, doc_id) AS rn FROM documents) WHERE rn <= 10")
def hash_sample(spark, d):
    return curate.hash_sample(t(spark, d, "documents").select("doc_id", "source"), "source", 10, F.col("doc_id") * 7919 % 10007, "doc_id")


@query("WITH h AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5) SELECT doc_id, source, CASE WHEN source IN (FROM h) THEN 'eval' ELSE 'train' END AS split FROM documents")
def speaker_holdout(spark, d):
    return curate.split_by_top(t(spark, d, "documents").select("doc_id", "source"), "source", 5)


@query()
def spread_topn(spark, d):
    e = t(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("start"), "value")
    return curate.spread_top(e, "user_id", "start", "value", 20, 86_400.0)


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def gold_join(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, l.quality IS NOT NULL AS done, coalesce(l.quality, -1) AS saved FROM documents LEFT JOIN labels l USING (doc_id)")
def saved_labels(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("done"), F.coalesce("quality", F.lit(-1)).alias("saved"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_pool(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id", "left_anti")


@query("WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT x.doc_id FROM x JOIN benchmark b ON trim(x.line) = trim(b.text))")
def leak_anti_join(spark, d):
    docs = t(spark, d, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    leaked = lines.join(t(spark, d, "benchmark").select(F.trim("text").alias("line")), "line").select("doc_id")
    return docs.select("doc_id").join(leaked, "doc_id", "left_anti")


_Z = "(x.n_chars - m1) / (s1 + 1e-9) + (x.o - m2) / (s2 + 1e-9)"


@query(
    f"WITH {_LEX}, o AS (SELECT doc_id, sum(CASE WHEN lex.word IS NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE AS o FROM tok LEFT JOIN lex USING (word) GROUP BY doc_id), "
    "x AS (SELECT doc_id, n_chars, o FROM documents JOIN o USING (doc_id)), m AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(o) AS m2, stddev_pop(o) AS s2 FROM x) "
    f"SELECT x.doc_id, round({_Z}, 6) AS z FROM x, m"
)
def zscore_hardness(spark, d):
    o = oov_rates(spark, d).join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return curate.z_hardness(o, "n_chars", "oov_rate").select("doc_id", F.round("z", 6).alias("z"))


_THRESHOLDS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1)


@query(f"SELECT l_returnflag, threshold, count(*) FILTER (l_discount <= threshold) AS n, coalesce(sum(l_quantity) FILTER (l_discount <= threshold), 0) AS amount FROM lineitem, (SELECT unnest([{', '.join(map(str, _THRESHOLDS))}]::DOUBLE[]) AS threshold) GROUP BY ALL")
def yield_sweep(spark, d):
    return curate.threshold_sweep(t(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", list(_THRESHOLDS))


@query("SELECT source, sum(n_chars)::BIGINT AS raw, sum(CASE WHEN n_chars BETWEEN 500 AND 5000 THEN n_chars ELSE 0 END)::BIGINT AS kept, count(*) AS n, count(*) FILTER (n_chars BETWEEN 500 AND 5000) AS n_kept, kept / greatest(raw, 0.01)::DOUBLE AS yield, n_kept / greatest(n, 1)::DOUBLE AS row_yield FROM documents GROUP BY source")
def yield_by_source(spark, d):
    return curate.yield_report(t(spark, d, "documents"), "source", "n_chars", F.col("n_chars").between(500, 5000))


@query(
    "WITH u AS (SELECT floor(o_totalprice)::BIGINT AS amount, 'orders' AS origin FROM orders UNION ALL SELECT floor(l_extendedprice)::BIGINT, 'lineitem' FROM lineitem) "
    "SELECT CASE WHEN grouping(origin) = 1 THEN 'TOTAL' ELSE origin END AS origin, sum(amount)::BIGINT AS amount, count(*) AS n, sum(amount)::DOUBLE / (SELECT sum(amount) FROM u) AS share FROM u GROUP BY ROLLUP (origin)"
)
def mix_composition(spark, d):
    u = curate.union_tagged(orders=t(spark, d, "orders").select(F.floor("o_totalprice").alias("amount")), lineitem=t(spark, d, "lineitem").select(F.floor("l_extendedprice").alias("amount")))
    return curate.composition(u, "origin", "amount")


@query(
    "WITH x AS (SELECT doc_id, CASE WHEN NOT n_chars BETWEEN 300 AND 10000 THEN 'length' WHEN NOT lang IN ('en', 'fr') THEN 'lang' WHEN coalesce(quality, 0) = 0 THEN 'quality' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1"
)
def gate_reasons(spark, d):
    j = t(spark, d, "documents").select("doc_id", "n_chars", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    g = curate.gate(j, ("length", F.col("n_chars").between(300, 10_000)), ("lang", F.col("lang").isin("en", "fr")), ("quality", F.col("quality") == 1))
    return g.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(DISTINCT doc_id) AS docs, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY ALL")
def distinct_counts(spark, d):
    return t(spark, d, "documents").groupBy("source", "lang").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("n_chars").alias("lengths"))


@query("SELECT quality, count(*) AS n, median(n_chars) AS median, min(n_chars) AS low, max(n_chars) AS high FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def coverage_by_label(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    j = j.select("quality", "n_chars")
    sums = j.groupBy("quality").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high")).alias("s")
    median = metrics.exact_percentiles(j, "n_chars", [0.5], "quality").select("quality", F.col("p")[0].alias("median")).alias("m")
    both = sums.join(median, F.col("s.quality").eqNullSafe(F.col("m.quality")), "left")
    return both.select("s.quality", "n", "median", "low", "high").orderBy(F.col("quality").asc_nulls_last())


# ------------------------------------------------------------------ sequences


@query("WITH r AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, event_type FROM r WHERE p IS DISTINCT FROM event_type AND event_type <> 'error'")
def run_collapse(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return sequence.collapse_runs(e, "user_id", "o", "event_type", blank=F.col("event_type") == "error").select("user_id", "event_id", "event_type")


@query(
    "WITH i AS (SELECT user_id, event_id, value, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM events), "
    'g AS (SELECT user_id, island, min(event_id) AS start, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, island::BIGINT AS island, start, n, lead(start) OVER (PARTITION BY user_id ORDER BY island) AS "end" FROM g'
)
def islands(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", "event_type")
    return sequence.spans(sequence.islands(e, "user_id", "event_id", F.col("event_type") == "view"), "user_id", "event_id", F.count("*").alias("n"))


_QUOTA = "SELECT user_id, ts::DATE AS day, event_id AS event, row_number() OVER w AS nth, row_number() OVER w <= 10 AS allowed, greatest(10 - row_number() OVER w, 0) AS remaining FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)"


@query(_QUOTA)
def daily_quota(spark, d):
    q = sequence.running_quota(t(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 10)
    return q.select("user_id", "day", F.col("event_id").alias("event"), "nth", "allowed", "remaining")


@query("WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600000000, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL")
def session_stats(spark, d):
    s = sequence.sessions(t(spark, d, "events"), "user_id", "ts", 21_600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def user_counts(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT doc_id, source, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), min(doc_id) OVER (PARTITION BY source)) AS next_doc_id FROM documents")
def shifted_pairs(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    return sequence.shifted_pairs(docs, "doc_id", "doc_id", "source")


@query("SELECT page_id, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS unique_name FROM (SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS name FROM pages))")
def collision_numbers(spark, d):
    p = t(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("name"))
    return sequence.collision_suffix(p, "name", "page_id").select("page_id", "unique_name")


@query(
    "WITH w AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS dur, greatest(ceil(n_chars / 100.0::DOUBLE / 28), 1)::INT AS k FROM documents), x AS (SELECT doc_id, dur, CASE WHEN k > 1 AND dur - (k - 1) * 28 < 4 THEN k - 1 ELSE k END AS k FROM w) "
    "SELECT doc_id, i AS window, (i * 28)::DOUBLE AS s, CASE WHEN i = k - 1 THEN dur ELSE (i + 1) * 28 END::DOUBLE AS e FROM (SELECT *, unnest(range(k)) AS i FROM x)"
)
def fixed_windows(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.posexplode(sequence.fixed_windows(F.col("n_chars") / F.lit(100.0))).alias("window", "x"))
    return w.select("doc_id", F.col("window").cast("bigint").alias("window"), "x.s", "x.e")


@query()
def stream_daily_quota(spark, d):
    from corvane.streaming import quota, stateful

    e = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return quota.run_to_table(stateful.quota(e, "user_id", "ts", "event_id", 10, delay="40 days"), "stream_daily_quota")


SQL["stream_daily_quota"] = _QUOTA


# ------------------------------------------------------------------ posteriors


def frames(spark, d):
    return posterior.frame_rows(t(spark, d, "embeddings"), "label", "vec_id", "embedding")


_FRAMES = """f AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT label, t, list_position(v, list_max(v)) - 1 AS k, list_max(v) - list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS lp, v FROM f)"""


@query(
    f"WITH {_FRAMES}, c AS (SELECT *, lag(k) OVER (PARTITION BY label ORDER BY t) AS p FROM k) SELECT label, list(k ORDER BY t) AS ids, round(exp(avg(lp)), 6) AS conf FROM c WHERE p IS DISTINCT FROM k AND k <> 0 GROUP BY label"
)
def ctc_greedy(spark, d):
    return posterior.greedy(frames(spark, d), "label", "t", "logp").withColumn("conf", F.round("conf", 6))


@query(
    f"WITH {_FRAMES}, l AS (SELECT label, k, list_transform(v, lambda x: x - list_max(v) + lp) AS q FROM k) "
    "SELECT label, round(avg(-list_sum(list_transform(q, lambda x: exp(x) * x)) / ln(len(q))), 6) AS entropy, count(*) AS frames FROM l WHERE k <> 0 GROUP BY label"
)
def frame_entropy(spark, d):
    return posterior.frame_entropy(frames(spark, d), "label", "logp").withColumn("entropy", F.round("entropy", 6))


_CTC = f"""{_FRAMES}, q AS (SELECT label, t, k, list_transform(v, lambda x: x - list_max(v) + lp) AS q FROM k),
c AS (SELECT *, lag(k) OVER (PARTITION BY label ORDER BY t) AS p FROM k), y AS (SELECT label, list(k ORDER BY t) AS ids FROM c WHERE p IS DISTINCT FROM k AND k <> 0 GROUP BY label)"""
_SWEEP = f"""{_FRAMES}, b AS (SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0])::DOUBLE AS beta), l AS (SELECT label, t, list_transform(v, lambda x: x - list_max(v) + lp) AS q FROM k),
z AS (SELECT label, beta, t, [q[1] - beta] || q[2:] AS q FROM l, b), m AS (SELECT label, beta, t, list_position(q, list_max(q)) - 1 AS k, list_max(q) AS lp FROM z),
c AS (SELECT *, lag(k) OVER (PARTITION BY label, beta ORDER BY t) AS p FROM m), g AS (SELECT label, beta, count(*)::INT AS n, round(exp(avg(lp)), 6) AS conf FROM c WHERE p IS DISTINCT FROM k AND k <> 0 GROUP BY ALL)"""


@query(f"WITH {_SWEEP} SELECT label, beta, n, conf FROM g")
def blank_sweep(spark, d):
    s = posterior.blank_sweep(frames(spark, d), "label", "t", "logp", [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0])
    return s.select("label", "beta", F.size("ids").alias("n"), F.round("conf", 6).alias("conf"))


_ALIGN = f"""{_CTC}, x AS (SELECT label, ids, flatten(list_transform(ids, lambda i: [0, i])) || [0] AS ext FROM y),
vt AS (SELECT label, 0 AS t, [q[1], q[ids[1] + 1]] || list_transform(range(3, len(ext) + 1), lambda s: -1e30) AS a, NULL::INT[] AS back FROM q JOIN x USING (label) WHERE t = 0
  UNION ALL SELECT label, t, list_transform(ext, lambda e, s: CASE back[s] WHEN 0 THEN a[s] WHEN 1 THEN a[s - 1] ELSE a[s - 2] END + q[e + 1]), back FROM (
    SELECT vt.label, q.t, a, ext, q, list_transform(range(1, len(ext) + 1), lambda s: CASE
      WHEN a[s] >= coalesce(a[s - 1], -1e30) AND (s < 4 OR s % 2 = 1 OR ext[s] = ext[s - 2] OR a[s] >= a[s - 2]) THEN 0
      WHEN s < 4 OR s % 2 = 1 OR ext[s] = ext[s - 2] OR a[s - 1] >= a[s - 2] THEN 1 ELSE 2 END)::INT[] AS back
    FROM vt JOIN q ON q.label = vt.label AND q.t = vt.t + 1 JOIN x ON x.label = vt.label)),
tb AS (SELECT label, t, CASE WHEN a[len(a)] >= a[len(a) - 1] THEN len(a) ELSE len(a) - 1 END::INT AS s FROM vt QUALIFY row_number() OVER (PARTITION BY label ORDER BY t DESC) = 1
  UNION ALL SELECT tb.label, tb.t - 1, tb.s - vt.back[tb.s] FROM tb JOIN vt ON vt.label = tb.label AND vt.t = tb.t WHERE tb.t > 0),
f2 AS (SELECT tb.label, tb.t, s // 2 - 1 AS k, ext[s] AS token, q[ext[s] + 1] AS own, list_max(q) AS best, list_transform(q, lambda v, i: CASE WHEN i IN (1, ext[s] + 1) THEN -1e30 ELSE v END) AS rival FROM tb JOIN q ON q.label = tb.label AND q.t = tb.t JOIN x ON x.label = tb.label WHERE s % 2 = 0),
f3 AS (SELECT *, list_position(rival, list_max(rival)) - 1 AS other FROM f2),
co AS (SELECT label, k, other FROM f3 GROUP BY label, k, other QUALIFY row_number() OVER (PARTITION BY label, k ORDER BY count(*) DESC, other) = 1),
al AS (SELECT f3.label, f3.k::INT AS k, token::INT AS token, min(t)::INT AS start, max(t)::INT + 1 AS end_, round(avg(own - best), 6) AS norm, avg(own) AS raw, any_value(co.other)::INT AS confuser FROM f3 JOIN co USING (label, k) GROUP BY ALL)"""


@query(f'WITH RECURSIVE {_ALIGN} SELECT label, k, token, start, end_ AS "end", norm, confuser FROM al')
def forced_alignment(spark, d):
    f = frames(spark, d)
    ids = posterior.greedy(f, "label", "t", "logp").select("label", "ids")
    return posterior.align_tokens(f, ids, "label").select("label", "k", "token", "start", "end", F.round("norm", 6).alias("norm"), "confuser")


@query(f"WITH RECURSIVE {_ALIGN}, n AS (SELECT token, confuser, count(*) AS n, sum(count(*)) OVER (PARTITION BY token)::BIGINT AS of FROM al GROUP BY token, confuser) SELECT token, confuser, n, of FROM n QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, confuser) = 1")
def confusion_map(spark, d):
    f = frames(spark, d)
    ids = posterior.greedy(f, "label", "t", "logp").select("label", "ids")
    return posterior.confusion_map(posterior.align_tokens(f, ids, "label"))


@query(f"WITH {_SWEEP} SELECT label, beta, round(1 - conf, 6) AS miss FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(1 - conf, 6), beta) = 1")
def best_blank_penalty(spark, d):
    s = posterior.blank_sweep(frames(spark, d), "label", "t", "logp", [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0])
    return posterior.best_setting(s.withColumn("miss", F.round(1 - F.col("conf"), 6)), ["beta"], "miss", "label")


def _either(a: str, b: str) -> str:
    """Logarithm of the sum of two probabilities."""
    return f"(greatest({a}, {b}) + ln(1 + exp(least({a}, {b}) - greatest({a}, {b}))))"


@query(
    f"WITH RECURSIVE {_CTC}, w AS (SELECT label, 'greedy' AS cand, ids FROM y UNION ALL SELECT label, 'without_last', ids[:len(ids) - 1] FROM y), x AS (SELECT *, flatten(list_transform(ids, lambda i: [0, i])) || [0] AS ext FROM w WHERE len(ids) > 0), "
    "fw AS (SELECT label, cand, 0 AS t, [q[1], q[ids[1] + 1]] || list_transform(range(3, len(ext) + 1), lambda s: -1e30) AS a FROM q JOIN x USING (label) WHERE t = 0 "
    f"UNION ALL SELECT fw.label, fw.cand, q.t, list_transform(ext, lambda e, s: {_either(_either('a[s]', 'coalesce(a[s - 1], -1e30)'), 'CASE WHEN s < 4 OR s % 2 = 1 OR e = ext[s - 2] THEN -1e30 ELSE a[s - 2] END')} + q[e + 1]) FROM fw JOIN q ON q.label = fw.label AND q.t = fw.t + 1 JOIN x ON x.label = fw.label AND x.cand = fw.cand), "
    f"z AS (SELECT label, cand, a FROM fw QUALIFY row_number() OVER (PARTITION BY label, cand ORDER BY t DESC) = 1) SELECT label, cand, round({_either('a[len(a)]', 'a[len(a) - 1]')}, 4) AS score FROM z UNION ALL SELECT label, cand, -1e30 FROM w WHERE len(ids) = 0"
)
def forward_scores(spark, d):
    f = frames(spark, d)
    ids = posterior.greedy(f, "label", "t", "logp").select("label", F.lit("greedy").alias("cand"), "ids")
    short = ids.select("label", F.lit("without_last").alias("cand"), F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))).alias("ids"))
    return posterior.sequence_scores(f, ids.unionByName(short), "label").withColumn("score", F.round("score", 4))
