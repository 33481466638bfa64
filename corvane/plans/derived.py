"""Registered queries of text in other scripts, gates, joins and votes, over whole driver tables.  Devanagari text is made
from the driver's Latin text, letter by letter, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import script, text
from corvane.operators import curate, fusion, lexicon, metre, posterior, sequence
from corvane.plans.catalog import _ALIGN, _BENCH, _FRAMES, _WORDS, bench_words, frames, query, t, turn_pairs

# A Latin letter, stop, digit or accent for each Devanagari sign.
_FROM = "abcdefghijklmnopqrstuvwxyz.,!?0123456789"
_TO = "ाबकद्ञगहिजखलमनोपङरसतुवंँयः।॥॑᳐०१२३४५६७८९"
_MARKS = "ा्िोुंँः॑᳐"
_CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"


def deva(c: Column) -> Column:
    return F.translate(F.lower(c), _FROM, _TO)


def _deva(c: str) -> str:
    return f"translate(lower({c}), '{_FROM}', '{_TO}')"


def _squeezed(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '[^ऀ-ॿ\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _profile(c: str, dropped: str) -> str:
    return _squeezed(f"regexp_replace({c}, '[{dropped}]', ' ', 'g')")


_STOPS, _VEDIC = "०-९।॥ऽॐ", "॒॑॓॔᳐-᳿"


def _undoubled(c: str) -> str:
    for m in _MARKS:
        c = f"regexp_replace({c}, '{m}+', '{m}', 'g')"
    return c


def _final(c: str) -> str:
    return rf"regexp_replace({c}, 'म्([\s।॥]|$)', 'ं\1', 'g')"


# ------------------------------------------------------------------ normalization


@query(
    f"WITH x AS (SELECT doc_id, nfc_normalize({_deva('text')}) AS x FROM documents) SELECT doc_id, {_profile('x', _STOPS)} AS base, {_profile('x', _STOPS + _VEDIC)} AS vedic, "
    f"{_profile(_final(_undoubled('x')), _STOPS + _VEDIC)} AS canonical, {_squeezed('x')} AS raw FROM x"
)
def norm_profiles(spark, d):
    x = t(spark, d, "documents").select("doc_id", text.nfc(deva(F.col("text"))).alias("x"))
    return x.select("doc_id", *(text.norm(F.col("x"), p, compose=False).alias(p) for p in ("base", "vedic", "canonical", "raw")))


_NASAL = (
    "array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] = 'ँ' THEN 'ं' WHEN contains('ङञणनम', c[i]) AND c[i + 1] = '्' AND contains('" + _CONSONANTS + "', coalesce(c[i + 2], '-')) THEN 'ं' "
    "WHEN c[i] = '्' AND i > 1 AND contains('ङञणनम', c[i - 1]) AND contains('" + _CONSONANTS + "', coalesce(c[i + 1], '-')) THEN '' ELSE c[i] END), '')"
)


@query(
    f"WITH x AS (SELECT item_id, {_deva('text')} AS x FROM benchmark), y AS (SELECT item_id, x, string_split(x, '') AS c FROM x) "
    rf"SELECT item_id, {_undoubled('x')} AS undoubled, {_final('x')} AS final_nasal, regexp_replace({_NASAL}, 'म्(\s|$)', 'ं\1', 'g') AS phonetic, replace(x, 'ं', 'म्') AS unfolded FROM y"
)
def nasal_folds(spark, d):
    x = t(spark, d, "benchmark").select("item_id", deva(F.col("text")).alias("x"))
    c = F.col("x")
    return x.select("item_id", text.dedup_marks(c).alias("undoubled"), text.fold_final_nasal(c).alias("final_nasal"), text.fold_nasals(c).alias("phonetic"), text.unfold_anusvara(c).alias("unfolded"))


_KANNADA = "೦೧೨೩೪೫೬೭೮೯"


@query(
    "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS key, "
    "CASE WHEN page_id % 3 = 0 THEN [(page_id % 17)::INT] ELSE range((page_id % 17)::INT, (page_id % 17 + page_id % 5)::INT + 1)::INT[] END AS numbers, "
    "regexp_extract_all(url, '[0-9]+')[-1]::INT AS last, CASE WHEN page_id % 4 > 0 THEN (page_id % 50)::INT END AS first_verse, CASE WHEN page_id % 4 > 0 THEN (page_id % 50 + 3)::INT END AS last_verse FROM pages"
)
def name_fields(spark, d):
    n = F.col("page_id")
    ranges = F.when(n % 3 == 0, (n % 17).cast("string")).otherwise(F.concat_ws("-", n % 17, n % 17 + n % 5))
    named = F.when(n % 4 > 0, F.concat(F.lit("Lecture Shloka"), F.when(n % 2 == 0, "s ").otherwise(" "), n % 50, F.lit(" - "), n % 50 + 3)).otherwise(F.lit("Lecture"))
    lo, hi = text.verse_hint(named)
    folded = F.translate("url", "0123456789", _KANNADA)
    return t(spark, d, "pages").select("page_id", text.alnum_key(F.col("url")).alias("key"), text.range_set(ranges).alias("numbers"), text.last_number(folded).alias("last"), lo.alias("first_verse"), hi.alias("last_verse"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '\W+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents")
def slugs(spark, d):
    return t(spark, d, "documents").select("doc_id", text.slug(F.concat("text", F.lit(".mp3.wav"))).alias("slug"))


_BODY = "coalesce(list_position(list_transform(l, lambda x: len(regexp_extract_all(x, '[äöüßéèêñóí]')) >= 2), true), 0)"


@query(
    "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l, string_split(regexp_replace(text, '([.,]) ', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents WHERE text IS NOT NULL) "
    f"SELECT doc_id, array_to_string(CASE WHEN {_BODY} > 0 THEN l[{_BODY}:] ELSE l END, chr(10)) AS body, "
    f"list_filter(list_transform(string_split_regex({_deva('array_to_string(s, chr(10))')}, '॥|\\n\\s*\\n'), lambda v: trim(v, ' ')), lambda v: v <> '') AS verses, "
    f"list_filter(list_transform(string_split_regex({_deva('array_to_string(s, chr(10))')}, '[।\\n]+'), lambda v: trim(v, ' ')), lambda v: v <> '') AS prose FROM x"
)
def bodies_and_verses(spark, d):
    x = t(spark, d, "documents").where("text is not null")
    broken = deva(F.regexp_replace("text", r"([.,]) ", "$1\n"))
    return x.select("doc_id", text.body_start(F.col("text"), "[äöüßéèêñóí]").alias("body"), text.verses(broken).alias("verses"), text.verses(broken, prose=True).alias("prose"))


@query("SELECT item_id, 1 AS number, chr(10) || text || chr(10) AS body FROM benchmark UNION ALL SELECT item_id, (item_id + 2)::INT, ' end ' || text FROM benchmark")
def chapter_sections(spark, d):
    whole = F.concat(F.lit("front === CHAPTER 1 ===\n"), "text", F.lit("\n=== CHAPTER "), (F.col("item_id") + 2).cast("string"), F.lit(" === end "), "text")
    return t(spark, d, "benchmark").select("item_id", F.explode(text.chapters(whole)).alias("c")).select("item_id", "c.number", "c.body")


@query(f"SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all({_deva('text')}, '[ऀ-ॿ]+'), lambda w: length(w) >= 3))) AS words FROM benchmark")
def hot_words(spark, d):
    return t(spark, d, "benchmark").select("item_id", text.hotwords(deva(F.col("text"))).alias("words"))


# ------------------------------------------------------------------ script and verse

_B = r"\x{905}-\x{939}\x{958}-\x{961}\x{972}-\x{97F}"
_CLEAN = _profile(_final(_undoubled(f"nfc_normalize({_deva('text')})")), _STOPS + _VEDIC)
_AKSHARAS = rf"""w AS (SELECT item_id, unnest({_WORDS.format(c=_CLEAN)}) AS w, generate_subscripts({_WORDS.format(c=_CLEAN)}, 1) AS wn FROM benchmark),
c AS (SELECT item_id, wn, unnest(a) AS a, generate_subscripts(a, 1) AS an, len(a) AS k FROM (SELECT *, regexp_extract_all(w, '^(?:[^{_B}]*्[{_B}])+[^{_B}]*|^[^{_B}]+|[{_B}](?:[^{_B}]*्[{_B}])*[^{_B}]*') AS a FROM w)),
g AS (SELECT *, row_number() OVER o AS n, sum(CASE WHEN a NOT LIKE '%्' THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS own FROM c WINDOW o AS (PARTITION BY item_id ORDER BY wn, an)),
u AS (SELECT item_id, own AS place, string_agg(a, '' ORDER BY n) AS text, last(an = k ORDER BY n) AS word_end FROM g GROUP BY ALL)"""


@query(f"WITH {_AKSHARAS} SELECT item_id, list(text ORDER BY place) AS aksharas, trim(string_agg(text || CASE WHEN word_end THEN ' ' ELSE '' END, '' ORDER BY place)) AS unit_text FROM u GROUP BY item_id")
def akshara_units(spark, d):
    clean = t(spark, d, "benchmark").select("item_id", text.norm(deva(F.col("text")), "canonical").alias("x"))
    a = clean.select("item_id", script.akshara(F.col("x")).alias("a"))
    return a.select("item_id", F.transform("a", lambda x: x["text"]).alias("aksharas"), script.unit_text(F.col("a")).alias("unit_text"))


def _metre_sql() -> str:
    """The first rule that fits a weight string w of n weights, as a struct (length, name)."""
    rule = lambda test, size, name: f"WHEN {test} THEN {{'length': ({size})::INT, 'name': {name}}}"
    out = [rule(f"n IN ({len(p)}, {2 * len(p)}, {4 * len(p)}) AND substr(w, 1, {len(p) - 1}) = '{p[:-1]}'", len(p), f"'{name}'") for p, name in script.METRES]
    out.append(rule("n IN (8, 16, 32)", 8, "'anuṣṭubh'"))
    for parts in (4, 2):
        same = " AND ".join(f"substr(w, n // {parts} * {k} + 1, n // {parts} - 1) = substr(w, 1, n // {parts} - 1)" for k in range(1, parts))
        out.append(rule(f"n % {parts} = 0 AND n // {parts} BETWEEN 5 AND 30 AND {same}", f"n // {parts}", f"'sama-' || (n // {parts})"))
    return "CASE " + " ".join(out) + " END"


_WEIGHTS = r"""l AS (SELECT doc_id, unnest(string_split_regex(text, '[.\n]+')) AS line FROM documents), s AS (SELECT doc_id, regexp_replace(line, '[^a-zA-Z~]', '', 'g') AS s FROM l),
v AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(s, '[aiufxAIUFXeEoO][^aiufxAIUFXeEoO]*'), lambda u: CASE WHEN regexp_matches(u, '^[AIUFXeEoO]|[MH~]') OR length(regexp_replace(u, '[MH~]', '', 'g')) >= 3 THEN 'G' ELSE 'L' END), '') AS w FROM s),
k AS (SELECT doc_id, w, length(w) AS n FROM v)"""


@query(f"WITH {_WEIGHTS}, m AS (SELECT {_metre_sql()} AS metre, n FROM k WHERE n > 0) SELECT metre.length AS length, metre.name AS name, count(*) AS lines, sum(n)::BIGINT AS weights FROM m GROUP BY ALL")
def metres_of_lines(spark, d):
    """Lines read as if they were SLP1: their weights and metres."""
    lines = t(spark, d, "documents").select(F.explode(F.split("text", r"[.\n]+")).alias("line")).where(F.col("line").rlike("[aiufxAIUFXeEoO]"))  # else no weights
    # each line's weights and metre are worked out once: a filter on weights, or two keys of a metre, would do so again
    m = lines.select(script.scansion(F.col("line")).alias("w")).select("w", script.metre(F.col("w")).alias("metre"))
    m = m.groupBy("metre").agg(F.count("*").alias("lines"), F.sum(F.length("w")).alias("weights"))
    return m.select("metre.length", "metre.name", "lines", "weights")


_KANNADA_TO = "".join(chr(ord(x) + 0x0380) if 0x0900 <= ord(x) < 0x0980 and x not in "।॥" else x for x in _TO)


@query(f"SELECT item_id, translate({_deva('text')}, '{_TO}', '{_KANNADA_TO}') AS kannada, {_deva('text')} AS back FROM benchmark")
def indic_transliteration(spark, d):
    x = t(spark, d, "benchmark").select("item_id", deva(F.col("text")).alias("x")).withColumn("kannada", script.transliterate(F.col("x"), "devanagari", "kannada"))
    return x.select("item_id", "kannada", script.transliterate(F.col("kannada"), "kannada").alias("back"))


# ------------------------------------------------------------------ gates


@query(
    rf"""WITH x AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, len({_WORDS.format(c='coalesce(text, $$$$)')}) AS w FROM documents d)
SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda z: z <> '')) >= 3 AS has_words, coalesce(regexp_matches(text, '[a-zA-Z]'), false) AS latin,
  starts_with(source, 'a') OR starts_with(source, 'b') OR starts_with(source, 'h') AS early,
  CASE WHEN contains(text, 'tion') THEN 'tion' WHEN contains(text, 'chen') THEN 'chen' WHEN contains(text, 'ado') THEN 'ado' ELSE 'other' END AS mark,
  CASE WHEN n_chars < 100 THEN 'discarded' WHEN n_chars / 10000.0::DOUBLE <= 0.2 THEN 'kept' WHEN n_chars / 10000.0::DOUBLE <= 0.35 THEN 'retained' ELSE 'discarded' END AS state,
  coalesce(nullif(regexp_extract(text, '([0-9]+)-[0-9]+', 1), ''), nullif(regexp_extract(text, '([0-9]+)', 1), '')) AS first_number FROM x"""
)
def text_gates(spark, d):
    c = F.col("text")
    first = text.first_field(c, [(r"([0-9]+)-[0-9]+", 1), (r"([0-9]+)", 1)])
    return t(spark, d, "documents").select(
        "doc_id", F.coalesce(curate.content_gate(c), F.lit(False)).alias("has_words"), F.coalesce(text.has_latin(c), F.lit(False)).alias("latin"), text.any_prefix(F.col("source"), ["a", "b", "h"]).alias("early"),
        text.first_rule(c, [("tion", "tion"), ("chen", "chen"), ("ado", "ado")], kind="contains", default="other").alias("mark"),
        curate.tri_state(F.col("n_chars") / 10000.0, F.col("n_chars") >= 100, 0.2, 0.35).alias("state"), first.alias("first_number"),
    )


_SIGNALS = "(doc_id * 37 % 101) / 100.0::DOUBLE AS agree, (doc_id * 53 % 101) / 100.0::DOUBLE AS conf, (doc_id * 71 % 101) / 100.0::DOUBLE AS corpus"


@query(
    f"WITH x AS (SELECT doc_id, {_SIGNALS} FROM documents) SELECT coalesce(CASE WHEN agree < 0.8 THEN 'agree' WHEN conf < 0.55 THEN 'conf' WHEN corpus < 0.6 THEN 'corpus' END, 'kept') AS three, "
    "coalesce(CASE WHEN conf < 0.55 THEN 'conf' WHEN corpus < 0.7 THEN 'corpus' END, 'kept') AS two, coalesce(CASE WHEN conf < 0.9 THEN 'lowconf' WHEN 1 - agree > 0.1 THEN 'disagree' END, 'kept') AS pseudo, count(*) AS n FROM x GROUP BY ALL"
)
def signal_gates(spark, d):
    share = lambda k: (F.col("doc_id") * k % 101) / F.lit(100.0)
    x = t(spark, d, "documents").select(share(37).alias("agree"), share(53).alias("conf"), share(71).alias("corpus"))
    three = curate.gate(x, ("agree", F.col("agree") >= 0.8), ("conf", F.col("conf") >= 0.55), ("corpus", F.col("corpus") >= 0.6)).withColumnRenamed("reason", "three")
    two = curate.gate(three, ("conf", F.col("conf") >= 0.55), ("corpus", F.col("corpus") >= 0.7)).withColumnRenamed("reason", "two")
    all_ = curate.pseudo_label_gate(two.withColumn("dis", 1 - F.col("agree")), "conf", "dis").withColumnRenamed("reason", "pseudo")
    kept = lambda c: F.coalesce(c, F.lit("kept")).alias(c)
    return all_.groupBy(kept("three"), kept("two"), kept("pseudo")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 9) AS rms FROM embeddings")
def vector_energy(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.round(text.rms(F.transform("embedding", lambda x: x.cast("double"))), 9).alias("rms"))


@query(
    f"WITH w AS (SELECT DISTINCT unnest({_WORDS.format(c=_CLEAN)}) AS word FROM benchmark) SELECT word FROM w WHERE length(word) >= 3 AND regexp_matches(word, '[क-ह]') AND length(word) - length(replace(word, '्', '')) <= 0.4 * length(word)"
)
def valid_words(spark, d):
    w = t(spark, d, "benchmark").select(F.explode(text.words(text.norm(deva(F.col("text")), "canonical"))).alias("word")).distinct()
    return w.where(text.valid_word(F.col("word")))


@query("SELECT client, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'user' || user_id WHEN event_id % 3 = 1 THEN 'proxy' || (user_id % 7) WHEN event_id % 5 = 0 THEN '?' ELSE 'socket' || (user_id % 11) END AS client FROM events) GROUP BY client")
def client_keys(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    header = F.when(e % 3 == 0, F.concat(F.lit("user"), u)).otherwise(F.lit(" "))
    forwarded = F.when(e % 3 == 1, F.concat(F.lit(" proxy"), u % 7, F.lit(", other")))
    socket = F.when(e % 5 != 0, F.concat(F.lit("socket"), u % 11))
    return t(spark, d, "events").select(text.client_key(header, forwarded, socket).alias("client")).groupBy("client").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ joins


@query(
    "WITH s AS (SELECT source, min(doc_id) AS first_doc, count(*) AS docs FROM documents GROUP BY source), b AS (SELECT 'src' || substr(md5(coalesce(source, '-')), 1, 6) AS base, * FROM s) "
    "SELECT p.page_id, b.source, b.docs FROM pages p JOIN (SELECT *, row_number() OVER (ORDER BY base) - 1 AS k, count(*) OVER () AS m FROM b) b ON p.page_id % b.m = b.k"
)
def basename_join(spark, d):
    """Rows that meet by the base name of a path, which is no column of either side."""
    s = t(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("docs"))
    base = F.concat(F.lit("src"), F.substring(F.md5(F.coalesce("source", F.lit("-"))), 1, 6))
    left = s.withColumn("path", F.concat(F.lit("/data/"), base, F.lit(".wav")))
    names = s.select(base.alias("base"))
    m = s.count()
    numbered = curate.ranked_sum(names.withColumn("one", F.lit(1)).withColumn("h", F.conv(F.substring("base", 4, 6), 16, 10).cast("bigint")), "one", "h").select("base", F.col("before").alias("k"))
    pages = t(spark, d, "pages").select("page_id", (F.col("page_id") % m).alias("k")).join(numbered, "k").withColumn("wav", F.concat(F.lit("/other/place/"), F.col("base"), F.lit(".flac")))
    key = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    return pages.withColumn("key", key("wav")).join(left.withColumn("key", key("path")), "key").select("page_id", "source", "docs")


@query(
    "WITH b AS (SELECT conv_id, turn, turn * 1500 AS s, turn * 1500 + 1200 AS e, text FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 > 0) "
    "SELECT 'c' || conv_id AS source_file, 'b' || turn AS block, text, s / 1000.0::DOUBLE + CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 0 END AS start, e / 1000.0::DOUBLE + CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 0 END AS end_ FROM b"
)
def session_texts(spark, d):
    """Timed blocks of sessions, the texts of their documents, and the sessions' offsets where there are any."""
    from corvane.sources.readers import session_blocks

    c = t(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("source_file"), F.concat(F.lit("b"), "turn").alias("id"), "turn", "text", "conv_id")
    blocks = F.collect_list(F.struct("id", (F.col("turn") * 1500).alias("start_ms"), (F.col("turn") * 1500 + 1200).alias("end_ms"))).alias("blocks")
    sessions = c.where("turn % 2 = 0").groupBy("source_file").agg(blocks)
    verse = F.array(F.struct(F.lit(1).alias("adhyaya"), F.col("turn").cast("string").alias("verse"), F.array("text").alias("text")))
    documents = c.where("conv_id % 3 > 0").groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("id", verse))).alias("content"))
    offsets = c.where("conv_id % 2 = 0").select("source_file", F.lit(0.5).alias("offset")).distinct()
    return session_blocks(sessions, documents, offsets).withColumnRenamed("end", "end_")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, text IS NOT NULL AND role = 'user' AS flag, (row_number() OVER (ORDER BY conv_id, turn) - 1) % 10 = 0 AS tenth FROM conversations")
def positions(spark, d):
    """Explicit places, and every tenth of them."""
    c = t(spark, d, "conversations").select("conv_id", "turn", (F.col("text").isNotNull() & (F.col("role") == "user")).alias("flag"))
    placed = curate.ranked_sum(c.withColumn("one", F.lit(1)), "one", "conv_id", "turn").drop("one")
    return placed.select("conv_id", "turn", F.col("before").alias("place"), "flag", (F.col("before") % 10 == 0).alias("tenth"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations) WHERE (n - 1) % 10 = 0")
def every_tenth(spark, d):
    return curate.every_kth(t(spark, d, "conversations").select("conv_id", "turn"), 10, "conv_id", "turn")


@query(
    "WITH j AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS source FROM documents), s AS (SELECT DISTINCT source FROM documents WHERE substr(md5(coalesce(source, '')), 1, 1) < '8') "
    "SELECT doc_id, CASE WHEN j.source IS NULL THEN 'no key' WHEN s.source IS NULL THEN 'no text' ELSE 'kept' END AS why FROM j LEFT JOIN s USING (source)"
)
def skip_with_report(spark, d):
    from corvane.sources.readers import with_report

    docs = t(spark, d, "documents")
    texts = docs.where(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1) < "8").select("source").distinct()
    kept, left = with_report(docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source")), texts, "source")
    return kept.select("doc_id", F.lit("kept").alias("why")).unionByName(left.select("doc_id", "why"))


_SPANS = """l AS (SELECT user_id, epoch(ts) % 86400 AS s, epoch(ts) % 86400 + 600 AS e FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, s + (user_id % 7) * 60 - 180 AS rs, e + (user_id % 7) * 60 - 180 AS re FROM l)"""


@query(
    f"WITH {_SPANS}, g AS (SELECT unnest(range(-240, 241, 60))::DOUBLE AS delta), p AS (SELECT l.user_id, delta, sum(greatest(least(e + delta, re) - greatest(s + delta, rs), 0)) AS overlap FROM l JOIN r USING (user_id), g GROUP BY ALL) "
    "SELECT user_id, delta, round(overlap, 3) AS overlap FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, delta) = 1"
)
def time_shifts(spark, d):
    """The constant shift of each user's intervals that makes most of them overlap another set."""
    second = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000)) / F.lit(1e6)
    l = t(spark, d, "events").where("event_type = 'view'").select("user_id", second.alias("s"), (second + 600).alias("e"))
    move = (F.col("user_id") % 7) * 60 - 180
    r = l.select("user_id", (F.col("s") + move).alias("s"), (F.col("e") + move).alias("e"))
    return sequence.grid_shift(l, r, "user_id", F.transform(F.sequence(F.lit(-240), F.lit(240), F.lit(60)), lambda x: x.cast("double"))).withColumn("overlap", F.round("overlap", 3))


@query(
    "WITH m AS (SELECT unnest(['short', 'medium', 'long']) AS config, unnest([500, 2000, 8000]) AS most), e AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS eval_lang) "
    "SELECT config, eval_lang, count(doc_id) AS n, coalesce(avg((n_chars <= most)::INT), 0) AS share FROM m CROSS JOIN e LEFT JOIN documents ON lang = eval_lang GROUP BY config, eval_lang"
)
def configuration_matrix(spark, d):
    return curate.matrix(t(spark, d, "documents"), {"short": F.col("n_chars") <= 500, "medium": F.col("n_chars") <= 2000, "long": F.col("n_chars") <= 8000}, "lang", ["de", "en", "es", "fr"])


# ------------------------------------------------------------------ segments, votes, rankings


@query(
    "WITH RECURSIVE x AS (SELECT doc_id, n_chars / 100.0::DOUBLE AS dur FROM documents WHERE n_chars > 0), "
    "m AS (SELECT doc_id, dur, unnest(range(1, 40)) * dur / 40 + (doc_id % 3) * 0.01 + 0.0001 AS mid FROM x), "
    "p AS (SELECT DISTINCT doc_id, round(mid, 3) AS c FROM m WHERE round(mid, 3) BETWEEN 0 AND dur UNION SELECT doc_id, 0.0::DOUBLE FROM x UNION SELECT doc_id, round(dur, 3) FROM x WHERE round(dur, 3) <= dur), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n FROM (SELECT doc_id, c AS s, lead(c) OVER (PARTITION BY doc_id ORDER BY c) AS e FROM p) WHERE e - s > 0.2), "
    "w AS (SELECT doc_id, n, s, e, 1 AS seg FROM g WHERE n = 1 UNION ALL SELECT g.doc_id, g.n, CASE WHEN w.e - w.s < 4 THEN w.s ELSE g.s END, g.e, CASE WHEN w.e - w.s < 4 THEN w.seg ELSE w.seg + 1 END FROM w JOIN g ON g.doc_id = w.doc_id AND g.n = w.n + 1), "
    "b AS (SELECT doc_id, seg, min(s) AS s, max(e) AS e, greatest(ceil((max(e) - min(s)) / 16), 1)::INT AS k FROM w GROUP BY ALL) "
    "SELECT doc_id, round(s + i * ((e - s) / k), 6) AS s, round(s + (i + 1) * ((e - s) / k), 6) AS e FROM (SELECT *, unnest(range(k)) AS i FROM b)"
)
def gap_segments(spark, d):
    """Cut at silence midpoints, slivers dropped, short segments grown and long ones split."""
    dur = F.col("n_chars") / F.lit(100.0)
    mids = F.transform(F.sequence(F.lit(1), F.lit(39)), lambda i: i * F.col("dur") / 40 + (F.col("doc_id") % 3) * F.lit(0.01) + F.lit(0.0001))
    silences = F.transform(mids, lambda m: F.struct((m - 0.05).alias("s"), (m + 0.05).alias("e")))
    x = t(spark, d, "documents").where("n_chars > 0").select("doc_id", dur.alias("dur"))
    x = x.withColumn("cuts", sequence.silence_cuts(silences, F.col("dur")))
    return x.select("doc_id", F.explode(sequence.merge_segments(F.col("cuts"))).alias("g")).select("doc_id", F.round("g.s", 6).alias("s"), F.round("g.e", 6).alias("e"))


@query(
    "SELECT source, count(*) FILTER (n_chars >= 2000) AS green, count(*) FILTER (n_chars < 500) AS red, count(*) FILTER (n_chars >= 500 AND n_chars < 2000) AS amber, coalesce(100.0::DOUBLE * green / nullif(green + red, 0), 0) AS percent "
    "FROM documents GROUP BY source HAVING percent >= 60 AND green + red >= 3"
)
def collectable_sources(spark, d):
    band = F.when(F.col("n_chars") >= 2000, "green").when(F.col("n_chars") < 500, "red").otherwise("amber")
    counts = fusion.band_counts(t(spark, d, "documents").select("source", band.alias("band")), "source", "band", strict=False)
    return fusion.collectable(counts, 60.0, 3)


@query(
    f"WITH {_BENCH}, x AS (SELECT b.word, (length(b.word) * 37 + ascii(b.word)) % 100 / 100.0::DOUBLE AS conf, lx.word IS NOT NULL AS known, length(b.word) % 2 = 0 AS close, length(b.word) >= 8 AS split, length(b.word) % 3 = 0 AS split_ok FROM b LEFT JOIN lx ON lx.word = b.word AND lx.freq >= 20) "
    "SELECT why, count(*) AS n FROM (SELECT CASE WHEN known AND conf >= 0.55 THEN 'trusted' WHEN length(word) < 3 THEN 'trusted' WHEN conf < 0.55 THEN 'lowconf' WHEN split AND split_ok THEN 'split' WHEN NOT known AND NOT (split AND NOT split_ok) AND close THEN 'typo' ELSE 'trusted' END AS why FROM x) GROUP BY why"
)
def word_flags(spark, d):
    left, lx = bench_words(spark, d)
    n = F.length("word")
    x = left.join(lx.where("freq >= 20").select("word", F.lit(True).alias("known")), "word", "left").withColumn("conf", (n * 37 + F.ascii("word")) % 100 / F.lit(100.0))
    why = fusion.flag(F.col("word"), F.coalesce("known", F.lit(False)), F.col("conf"), n % 2 == 0, n >= 8, n % 3 == 0)
    return x.select(F.coalesce(why, F.lit("trusted")).alias("why")).groupBy("why").agg(F.count("*").alias("n"))


_SCORED = f"WITH {_BENCH}, c AS (SELECT b.word, lx.word AS cand, freq, levenshtein(b.code, lx.code) AS dist, (length(lx.word) * 31 + freq * 17) % 101 AS score, (length(b.word) * 13) % 101 AS own FROM b JOIN lx ON abs(length(b.word) - length(lx.word)) <= 2 AND b.word <> lx.word), n AS (SELECT * FROM c WHERE dist <= 2) "


def _scored(spark, d):
    c = lexicon.fuzzy(*bench_words(spark, d), k=None)
    return c.withColumns({"score": (F.length("cand") * 31 + F.col("freq") * 17) % 101, "own": (F.length("word") * 13) % 101})


@query(_SCORED + "SELECT word, CASE WHEN max(score) > any_value(own) THEN arg_max(cand, {'s': score, 'f': -freq, 'c': cand}) ELSE word END AS projected FROM n GROUP BY word")
def gated_projection(spark, d):
    return fusion.project_gated(_scored(spark, d), "score", "own")


@query(
    _SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, freq DESC, cand) AS f, row_number() OVER (PARTITION BY word ORDER BY score DESC, cand) AS s, max(cand) OVER (PARTITION BY word) AS truth FROM n) "
    "SELECT dist, count(*) AS n, avg((f <= 1)::INT) AS by_freq_top1, avg((f <= 5)::INT) AS by_freq_top5, avg((s <= 1)::INT) AS by_score_top1, avg((s <= 5)::INT) AS by_score_top5 FROM r WHERE cand = truth GROUP BY dist"
)
def rankings_compared(spark, d):
    c = _scored(spark, d)
    truth = c.groupBy("word").agg(F.max("cand").alias("truth"))
    return fusion.compare_rankings(c.join(truth, "word"), "truth", "score")


@query(
    _SCORED + "SELECT least(dist, 3) AS distance, count(*) AS n, avg((freq >= 5)::INT) AS in_lexicon, avg((score >= 10)::INT) AS generated, avg((score >= 50)::INT) AS top5, avg((score >= 90)::INT) AS top1 FROM n GROUP BY 1"
)
def recall_by_distance(spark, d):
    c = _scored(spark, d).withColumns({"in_lexicon": F.col("freq") >= 5, "generated": F.col("score") >= 10, "top5": F.col("score") >= 50, "top1": F.col("score") >= 90})
    return lexicon.bucketed_recall(c)


# ------------------------------------------------------------------ posteriors


_OWN = f"{_FRAMES}, c AS (SELECT *, lag(k) OVER (PARTITION BY label ORDER BY t) AS p FROM k), m AS (SELECT label, t, k, lp FROM c WHERE p IS DISTINCT FROM k AND k <> 0)"


@query(
    f"WITH {_OWN}, i AS (SELECT *, sum((k % 5 = 0)::INT) OVER (PARTITION BY label ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT label, island, min(t) AS start, round(exp(avg(lp)), 6) AS conf, round(min(lp), 6) AS worst, count(*) AS tokens FROM i GROUP BY ALL) "
    "SELECT label, island::BIGINT AS island, start, conf, worst, tokens, lead(start) OVER (PARTITION BY label ORDER BY island) AS end_ FROM g"
)
def word_confidences(spark, d):
    """Words as islands of emitted tokens: their span, the geometric mean of token probabilities and the worst token."""
    best = frames(spark, d).select("label", "t", posterior.argmax(F.col("logp")).alias("k"), F.array_max("logp").alias("lp"))
    emitted = sequence.collapse_runs(best, "label", "t", "k", blank=F.col("k") == 0)
    w = posterior.word_confidence(emitted, "label", "t", F.col("k") % 5 == 0, "lp", worst=True)
    return w.select("label", "island", "start", F.round("conf", 6).alias("conf"), F.round("worst", 6).alias("worst"), "tokens", F.col("end").alias("end_"))


@query("SELECT label, duration / n AS frame_seconds, duration FROM (SELECT label, count(*) AS n, (label + 1) * 2.5::DOUBLE AS duration FROM embeddings GROUP BY label)")
def frame_spacing(spark, d):
    f = frames(spark, d).withColumn("duration", (F.col("label") + 1) * F.lit(2.5))
    return posterior.spread_times(f, "label", "duration")


@query(f"WITH {_FRAMES}, s AS (SELECT vec_id, embedding::DOUBLE[] AS v, [embedding[4]::DOUBLE] || embedding[9:13]::DOUBLE[] AS w FROM embeddings) SELECT vec_id, list_transform(w, lambda x: round(x - list_max(w) - ln(list_sum(list_transform(w, lambda y: exp(y - list_max(w))))), 6)) AS kept FROM s")
def column_selection(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.transform(posterior.select_columns(F.col("embedding").cast("array<double>"), 3, 8, 5), lambda x: F.round(x, 6)).alias("kept"))


@query(
    "WITH n AS (SELECT label, vec_id, embedding[1]::DOUBLE AS am, embedding[2]::DOUBLE AS lm, (vec_id % 9)::INT AS len FROM embeddings), a AS (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS alpha) "
    "SELECT alpha, label, arg_max(vec_id, {'s': am + alpha * lm + 0.1 * len, 'v': vec_id}) AS vec_id, round(max(am + alpha * lm + 0.1 * len), 6) AS total FROM n, a GROUP BY alpha, label"
)
def rescored_nbest(spark, d):
    v = F.col("embedding").cast("array<double>")
    n = t(spark, d, "embeddings").select("label", "vec_id", v[0].alias("am"), v[1].alias("lm"), (F.col("vec_id") % 9).cast("int").alias("len"))
    return posterior.rescore_sweep(n, "label", "vec_id", "am", "lm", "len", [0.0, 0.25, 0.5, 1.0], 0.1).withColumn("total", F.round("total", 6))


@query("SELECT vec_id, CASE WHEN c THEN vec_id % 5 ELSE vec_id % 7 END AS token, c AS corrupted FROM (SELECT vec_id, ('0x' || substr(md5('7:' || vec_id || ':' || label), 1, 8))::BIGINT % 10000 < 3000 AND vec_id % 7 <> vec_id % 5 AS c FROM embeddings)")
def corrupted_tokens(spark, d):
    tokens = t(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7).alias("token"), (F.col("vec_id") % 5).alias("other"))
    return posterior.corrupt(tokens, ["vec_id", "label"], "token", "other", share=0.3).select("vec_id", "token", "corrupted")


# ------------------------------------------------------------------ agreement of two systems with gates


@query()
def gated_runs(spark, d):
    """Runs of equal words of two systems, with the mean confidence and the corpus share of their words and their span."""
    p = turn_pairs(spark, d)
    lx = bench_words(spark, d)[1].where("freq >= 5")
    return fusion.gated_runs(p, ["conv_id", "turn"], "ref", "hyp", lx, seconds_per_word=0.4)


_SHIFT = "greatest(least(e + {d}, re) - greatest(s + {d}, rs), 0)"


@query(
    f"WITH {_SPANS}, o AS (SELECT user_id, delta, sum({_SHIFT.format(d='delta')}) AS overlap FROM l JOIN r USING (user_id), (SELECT unnest(range(-240, 241, 60))::DOUBLE AS delta) GROUP BY ALL), c AS (SELECT user_id, delta AS rough FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, delta) = 1), "
    f"f AS (SELECT user_id, rough + d AS delta, sum({_SHIFT.format(d='(rough + d)')}) AS overlap FROM l JOIN r USING (user_id) JOIN c USING (user_id), (SELECT unnest(range(-60, 61, 20))::DOUBLE AS d) GROUP BY ALL), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(overlap, 6) DESC, delta) = 1), "
    "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS m FROM l) WHERE n = least(floor(m * 0.8), m - 1)), "
    "v AS (SELECT DISTINCT k.user_id FROM k JOIN b USING (user_id) JOIN r USING (user_id) WHERE k.s + delta < re AND rs < k.e + delta) "
    "SELECT b.user_id, b.delta, round(b.overlap, 3) AS overlap, v.user_id IS NOT NULL AS valid FROM b LEFT JOIN v USING (user_id)"
)
def searched_shifts(spark, d):
    """Coarse, then fine, with a check at four fifths of each user's intervals."""
    second = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000)) / F.lit(1e6)
    l = t(spark, d, "events").where("event_type = 'view'").select("user_id", second.alias("s"), (second + 600).alias("e"))
    move = (F.col("user_id") % 7) * 60 - 180
    r = l.select("user_id", (F.col("s") + move).alias("s"), (F.col("e") + move).alias("e"))
    return sequence.shift_search(l, r, "user_id", 240.0, 60.0, 20.0).withColumn("overlap", F.round("overlap", 3))


@query(
    f"WITH RECURSIVE {_ALIGN}, g AS (SELECT label, k // 8 AS part, min(start) * 0.5 AS start_s, max(end_) * 0.5 AS end_s, avg(raw) AS score FROM al GROUP BY ALL) "
    "SELECT label, part::BIGINT AS part, start_s::DOUBLE AS start_s, end_s::DOUBLE AS end_s, round(score, 6) AS score FROM g WHERE score >= -4 AND end_s - start_s BETWEEN 1 AND 20"
)
def aligned_segments(spark, d):
    f = frames(spark, d)
    ids = posterior.greedy(f, "label", "t", "logp").select("label", "ids")
    s = posterior.segments(posterior.align_tokens(f, ids, "label"), "label", F.floor(F.col("k") / 8), 0.5, least=-4.0)
    return s.withColumn("score", F.round("score", 6))


@query(
    f"WITH RECURSIVE {_ALIGN}, w AS (SELECT f3.*, row_number() OVER (PARTITION BY label, k ORDER BY own - best, t) AS n FROM f3) "
    "SELECT w.label, w.k::INT AS k, w.token::INT AS token, round(al.raw, 6) AS raw, w.t::INT AS worst_frame, round(own, 6) AS worst_own, other::INT AS worst_rival, round(list_max(rival), 6) AS worst_rival_lp, round(own - list_max(rival), 6) AS margin "
    "FROM w JOIN al ON al.label = w.label AND al.k = w.k WHERE n = 1"
)
def alignment_diagnostics(spark, d):
    """Of each aligned token its mean score, its worst frame, and the strongest other symbol there."""
    f = frames(spark, d)
    ids = posterior.greedy(f, "label", "t", "logp").select("label", "ids")
    a = posterior.align_tokens(f, ids, "label")
    shown = {c: F.round(c, 6) for c in ("raw", "worst_own", "worst_rival_lp")}
    return a.select("label", "k", "token", "raw", "worst_frame", "worst_own", "worst_rival", "worst_rival_lp", (F.col("worst_own") - F.col("worst_rival_lp")).alias("margin")).withColumns(shown | {"margin": F.round("margin", 6)})


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 OR url IS NULL THEN '' ELSE upper(substr(url, 1, 12)) END AS answer FROM pages")
def enriched_rows(spark, d):
    """What a service says of each row over HTTP, '' where it fails.  The service here is a small one on the driver's host,
    which refuses some rows, breaks off others' answers, and shouts the rest; it lives as long as the driver."""
    from corvane.sources.readers import enriched, http_call

    asked = t(spark, d, "pages").select("page_id", F.concat_ws(" ", "page_id", "url").alias("q"))
    return enriched(asked, http_call(_service(spark), timeout=10.0), "q", "answer").select("page_id", "answer")


def _service(spark) -> str:
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            number, _, url = self.rfile.read(int(self.headers["Content-Length"])).decode().partition(" ")
            if int(number) % 10 == 0:
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            answer = json.dumps({"raw_text": url[:12].upper()})
            self.wfile.write((answer[:5] if int(number) % 10 == 5 else answer).encode())

        def log_message(self, *_):
            pass

    host = spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), Service)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://{host}:{server.server_port}/transcribe"


# ------------------------------------------------------------------ verse units


@query(
    "WITH x AS (SELECT item_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w, (item_id % 5 + 3)::INT AS n FROM benchmark) "
    "SELECT item_id, i::INT AS pada, list_transform(w[i * n + 1:(i + 1) * n], lambda v, k: v || CASE WHEN k = len(w[i * n + 1:(i + 1) * n]) OR length(v) % 2 = 0 THEN ' ' ELSE '' END) AS parts FROM (SELECT *, unnest(range((len(w) - 1) // n + 1)) AS i FROM x WHERE len(w) > 0)"
)
def quarter_rows(spark, d):
    """Units in groups of a length, the last of each marked as a word end."""
    w = F.filter(F.split("text", " "), lambda x: x != "")
    units = F.transform(w, lambda x: F.struct(x.alias("text"), (F.length(x) % 2 == 0).alias("word_end")))
    x = t(spark, d, "benchmark").select("item_id", script.padas(units, (F.col("item_id") % 5 + 3).cast("int")).alias("p"))
    shown = F.transform("g", lambda u: F.concat(u["text"], F.when(u["word_end"], " ").otherwise("")))
    return x.select("item_id", F.posexplode("p").alias("pada", "g")).select("item_id", "pada", shown.alias("parts"))


@query(
    "WITH x AS (SELECT conv_id AS item, turn % 3 AS verse, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) - 1 AS place, text AS line, role FROM conversations WHERE text IS NOT NULL), "
    "u AS (SELECT *, place // 2 AS unit FROM x) SELECT item, verse::INT AS verse, unit::INT AS unit, arg_min(role, place) AS metre, string_agg(trim(line), ' ' ORDER BY place) AS text, string_agg(trim(line), chr(10) ORDER BY place) AS tts_text FROM u GROUP BY item, verse, unit"
)
def paired_units(spark, d):
    """Consecutive pairs of a verse's quarters, here the turns of a conversation."""
    c = t(spark, d, "conversations").where("text is not null")
    one = F.array(F.struct(F.col("text"), F.lit(True).alias("word_end")))
    padas = c.select(F.col("conv_id").alias("item"), (F.col("turn") % 3).cast("int").alias("verse"), F.col("turn").cast("int").alias("pada"), F.col("role").alias("metre"), one.alias("aksharas"))
    return metre.units(padas, "item", "ardha").drop("aksharas")


@query(
    "WITH u AS (SELECT lang || '-' || source AS text, 'm' || (n_chars % 3) AS metre, doc_id AS verse, 0 AS unit FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), f AS (SELECT text, arg_min(metre, verse) AS metre FROM u GROUP BY text), "
    "k AS (SELECT *, substr(sha1(text || '|' || metre || '|60'), 1, 16) AS key FROM f) SELECT text, metre, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE metre = 'm1')"
)
def jobs_to_render(spark, d):
    """Distinct texts with the first metre seen, less those that are there already."""
    u = t(spark, d, "documents").where("lang is not null and source is not null").select(F.concat_ws("-", "lang", "source").alias("text"), F.concat(F.lit("m"), F.col("n_chars") % 3).alias("metre"), F.col("doc_id").alias("verse"), F.lit(0).alias("unit"))
    every = metre.render_jobs(u, u.select(F.lit("").alias("key")).limit(0))
    return metre.render_jobs(u, every.where("metre = 'm1'").select("key")).select("text", "metre", "key")
