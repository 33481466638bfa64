"""Frequency lexicons: building, membership, fuzzy and split candidates, tiling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import align
from corvane.functions.text import words


def tokens(df: DataFrame, text: Column, *keep: str, least: int = 1) -> DataFrame:
    return df.select(*keep, F.explode(words(text)).alias("word")).where(F.length("word") >= least)


def by_tag(df: DataFrame, tag: str, text: Column, least: int = 2) -> DataFrame:
    return tokens(df, text, tag, least=least).groupBy(tag, "word").agg(F.count("*").alias("freq"))


def tag_summary(df: DataFrame, tag: str, text: Column, least: int = 2) -> DataFrame:
    """Files, tokens and types of each tag, null among them; word counts are aggregated before types are counted."""
    lexicon = by_tag(df, tag, text, least).groupBy(F.col(tag).alias("_tag")).agg(F.sum("freq").alias("tokens"), F.count("*").alias("types"))
    files = df.groupBy(tag).agg(F.count("*").alias("files"))
    return files.join(lexicon, F.col(tag).eqNullSafe(F.col("_tag")), "left").select(tag, "files", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "types")))


def weighted(corpus: DataFrame, glossary: DataFrame, bonus: int = 50, least: int = 2) -> DataFrame:
    """word, freq: one for each corpus token (a table with counts n has them summed) and a bonus for each glossary word,
    from a least frequency on."""
    rows = corpus.select("word", F.col("n") if "n" in corpus.columns else F.lit(1).alias("n")).unionByName(glossary.select("word", F.lit(bonus).alias("n")))
    return rows.groupBy("word").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)


def counted(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, word, n) of each key's words."""
    return tokens(df, text, key).groupBy(key, "word").agg(F.count("*").alias("n"))


def oov(df: DataFrame, key: str, text: Column, lexicon: DataFrame) -> DataFrame:
    """Tokens and out-of-vocabulary rate of each key."""
    return oov_of(counted(df, key, text), key, lexicon)


def oov_of(counts: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    t = counts.join(lexicon.select("word", F.lit(True).alias("known")), "word", "left")
    return t.groupBy(key).agg(F.sum("n").alias("tokens"), (F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("oov_rate"))


def oov_once(df: DataFrame, key: str, text: Column, glossary: DataFrame) -> DataFrame:
    """(key, tokens, oov_rate) under the lexicon of the same texts' words that occur twice or more, and the glossary's.  What
    it lacks are words that occur once, so each tells its own key: words are counted with that key, and the pairs of keys and
    words are not shuffled."""
    w = df.select(F.col(key).alias("_key"), words(text).alias("w"))
    total = w.groupBy("_key").agg(F.sum(F.size("w")).alias("tokens")).where("tokens > 0")
    counts = w.select("_key", F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.min("_key").alias("_key")).where("n = 1")
    lacking = counts.join(glossary.select("word"), "word", "left_anti").groupBy(F.col("_key").alias("_of")).agg(F.count("*").alias("lacking"))
    rate = F.coalesce("lacking", F.lit(0)) / F.col("tokens")
    return total.join(lacking, F.col("_key").eqNullSafe(F.col("_of")), "left").select(F.col("_key").alias(key), "tokens", rate.alias("oov_rate"))


def fuzzy(left: DataFrame, lexicon: DataFrame, most: int = 2, k: int | None = 5) -> DataFrame:
    """(word, cand, freq, dist) within an edit distance, other than the word itself; the k best by distance, frequency
    and word.

    The lexicon is cut to words whose length a word of the other side allows.  Both sides are keyed by their deletion neighbourhoods: two words within `most` edits share a string that `most`
    deletions or fewer make of each.  That equi-key keeps the join from comparing whole length bands, and the distance
    is confirmed on the pairs."""
    found = _neighbours(left, lexicon, most).withColumn("dist", F.levenshtein("word", "cand", most)).where("dist >= 0")
    if k is None:
        return found
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("word").orderBy("dist", F.desc("freq"), "cand"))
    return found.withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


#: Words of the left side up to this number are broadcast with their deletion keys.
BROADCAST_WORDS = 5_000


def _neighbours(left: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """(word, cand, freq) of different words that share a deletion key."""
    l = left.select("word").distinct()
    few = l.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    lengths = l.select(F.explode(F.sequence(F.length("word") - most, F.length("word") + most)).alias("length")).distinct()
    r = lexicon.withColumn("length", F.length("word")).join(lengths, "length", "left_semi")
    l = l.select("word", F.explode(_deletions(F.col("word"), most)).alias("key"))
    r = r.select(F.col("word").alias("cand"), "freq", F.explode(_deletions(F.col("word"), most)).alias("key"))
    # a table's file says nothing about the size of its words' deletion keys, so it must not choose the join
    pairs = r.join(F.broadcast(l) if few else l.hint("merge"), "key").where((F.col("word") != F.col("cand")) & (F.abs(F.length("word") - F.length("cand")) <= most))
    return pairs.select("word", "cand", "freq").distinct()


def _deletions(w: Column, most: int) -> Column:
    """The word and all it becomes by up to `most` deletions."""
    drop = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    level = F.array(w)
    out = level
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: F.length(x) > 0), drop)))
        out = F.array_distinct(F.concat(out, level))
    return out


def edit_one(left: DataFrame, lexicon: DataFrame, alphabet: str | None = None) -> DataFrame:
    """(word, cand, freq): lexicon words one deletion, substitution, insertion or transposition of neighbours away.  With
    an alphabet only its letters are put in; without, any letter is, and words meet by what one deletion makes of both."""
    if alphabet is None:
        pairs, x, y = _neighbours(left, lexicon, 1), F.col("word"), F.col("cand")
        swap = lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x)))
        swapped = (F.length(x) == F.length(y)) & (F.length(x) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: swap(i) == y)
        return pairs.where((F.levenshtein(x, y, 1) >= 0) | swapped)
    letters = F.array(*(F.lit(c) for c in alphabet))
    w = F.col("word")
    head, tail = (lambda i: F.substring(w, F.lit(1), i)), (lambda i: F.substring(w, i + 1, F.length(w)))
    at = F.sequence(F.lit(0), F.length(w))
    inner = F.filter(at, lambda i: i < F.length(w))
    deleted = F.transform(inner, lambda i: F.concat(head(i), tail(i + 1)))
    put = lambda spots, skip: F.flatten(F.transform(spots, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + skip)))))
    swapped = F.transform(F.filter(at, lambda i: i < F.length(w) - 1), lambda i: F.concat(head(i), F.substring(w, i + 2, F.lit(1)), F.substring(w, i + 1, F.lit(1)), tail(i + 2)))
    keys = left.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(deleted, put(inner, 1), put(at, 0), swapped))).alias("cand"))
    return keys.where("word <> cand").join(lexicon.select(F.col("word").alias("cand"), "freq"), "cand").select("word", "cand", "freq")


def splits(left: DataFrame, lexicon: DataFrame, least: int = 6, part: int = 2) -> DataFrame:
    """(word, first, second, freq): of words long enough the split into two lexicon words with most frequency; the
    earliest of equals."""
    w = F.col("word")
    points = left.select("word").distinct().where(F.length(w) >= least).select("word", F.explode(F.sequence(F.lit(part), F.length(w) - part)).alias("at"))
    halves = points.select("word", "at", F.substring(w, F.lit(1), F.col("at")).alias("first"), F.substring(w, F.col("at") + 1, F.length(w)).alias("second"))
    a, b = lexicon.select(F.col("word").alias("first"), F.col("freq").alias("f1")), lexicon.select(F.col("word").alias("second"), F.col("freq").alias("f2"))
    found = halves.join(a, "first").join(b, "second").withColumn("freq", F.col("f1") + F.col("f2"))
    best = F.max_by(F.struct("first", "second", "freq"), F.struct("freq", (-F.col("at")).alias("o")))
    return found.groupBy("word").agg(best.alias("b")).select("word", "b.*")


def best_tiling(word: str, hits: list, penalty: float) -> list[str]:
    """The word cut into hits (end, start, log frequency) with the largest sum less a penalty each; the whole if they do
    not cover it.  Hits come by end and start, and the first of equal sums (to rounding) stays."""
    reached = {0: (0.0, 0)}
    for end, start, gain in hits:
        if start in reached and (end not in reached or reached[start][0] + gain - penalty > reached[end][0] + 1e-9):
            reached[end] = (reached[start][0] + gain - penalty, start)
    cuts = [len(word)]
    while cuts[-1] and cuts[-1] in reached:
        cuts.append(reached[cuts[-1]][1])
    return [word] if cuts[-1] else [word[a:b] for b, a in zip(cuts[-2::-1], cuts[:0:-1])]


def tiled(df: DataFrame, word: str, lexicon: DataFrame, penalty: float = 6.0, least: int = 2, most: int = 22) -> DataFrame:
    """Adds pieces: a word of known pieces, or the whole if it is under six characters, known or cannot be covered.  The
    substrings of distinct words find the lexicon by a join, so a lexicon of any size will do; one word's hits meet in a
    task."""
    w, n = F.col("word"), F.length("word")
    known = lexicon.crossJoin(F.broadcast(lexicon.agg(F.sum("freq").alias("all")))).select(F.col("word").alias("piece"), F.log(F.col("freq") / F.col("all")).alias("gain"))
    long_ = df.select(F.col(word).alias("word")).distinct().where(n >= 6).join(lexicon.select("word"), "word", "left_anti")
    starts = long_.select("word", F.explode(F.sequence(F.lit(0), n - least)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.col("start") + least, F.least(F.col("start") + most, n))).alias("end"))
    spans = spans.withColumn("piece", F.substring(w, F.col("start") + 1, F.col("end") - F.col("start")))
    hits = spans.join(known, "piece").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("end", "start", "gain"))).alias("hits"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(words_: pd.Series, hits_: pd.Series) -> pd.Series:
        return pd.Series([best_tiling(x, [(h["end"], h["start"], h["gain"]) for h in found], penalty) for x, found in zip(words_, hits_, strict=True)])

    made = hits.select(F.col("word").alias(word), run("word", "hits").alias("pieces"))
    return df.join(made, word, "left").withColumn("pieces", F.when(F.col(word).isNotNull(), F.coalesce("pieces", F.array(word))))


def near_misses(pairs: DataFrame, most: int = 2, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Distinct words that stand within an edit distance for another word: only these can have the right word among their
    candidates."""
    ops = pairs.select(F.explode(align.word_ops(ref, hyp)).alias("o")).where("o.op = 'S'")
    return ops.where(F.levenshtein("o.rc", "o.hc", most) >= 0).select(F.col("o.hc").alias("word")).distinct()


def recoverability(pairs: DataFrame, candidates: DataFrame, lexicon: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Of reference words: already right, recoverable among a wrong word's candidates, and the lexicon's ceiling."""
    ops = pairs.select(F.explode(align.word_ops(ref, hyp)).alias("o")).where("o.op <> 'I'").select("o.op", F.col("o.rc").alias("rc"), F.col("o.hc").alias("word"))
    cands = candidates.groupBy("word").agg(F.collect_list("cand").alias("cands"))  # k for each word
    known = lexicon.select(F.col("word").alias("rc"), F.lit(True).alias("known"))
    j = ops.join(cands.hint("merge"), "word", "left").join(known.hint("merge"), "rc", "left")
    right = F.col("op") == "M"
    hit = ~right & F.coalesce(F.array_contains("cands", F.col("rc")), F.lit(False))
    return j.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(hit).alias("recoverable"), F.count_if(F.col("known").isNotNull()).alias("in_lexicon"))


def bucketed_recall(df: DataFrame, dist: str = "dist") -> DataFrame:
    """(n, in_lexicon, generated, top5, top1) by true distance 1, 2, 3 and more; df has these flags as booleans."""
    flags = ("in_lexicon", "generated", "top5", "top1")
    return df.groupBy(F.least(F.col(dist), F.lit(3)).alias("distance")).agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("int")).alias(f) for f in flags))
