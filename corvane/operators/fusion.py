"""Fusion of several systems: votes, consensus bands, flagging and lexicon projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import align
from corvane.functions.text import chars, words


def rover(a: Column, b: Column, c: Column) -> Column:
    """Vote on the characters of backbone a: the other two override it where they agree, on '' by deleting."""
    zipped = F.arrays_zip(chars(a).alias("a"), align.onto(a, b).alias("b"), align.onto(a, c).alias("c"))
    return F.array_join(F.transform(zipped, lambda x: F.when((x["b"] == x["c"]), x["b"]).otherwise(x["a"])), "")


def bands(ops: Column) -> tuple[Column, Column]:
    """(strict, liberal) band of a unit from its ops in each decode, an array of (kind, heard).

    strict: green if all match, red if none does, else amber.  liberal: green if any matches, red if all are
    substitutions by one and the same unit, else amber."""
    hit = lambda o: o["kind"] == "match"
    strict = F.when(F.forall(ops, hit), "green").when(~F.exists(ops, hit), "red").otherwise("amber")
    one = F.forall(ops, lambda o: o["kind"] == "sub") & (F.size(F.array_distinct(F.transform(ops, lambda o: o["heard"]))) == 1)
    return strict, F.when(F.exists(ops, hit), "green").when(one, "red").otherwise("amber")


def consensus(ref: Column, decodes: list[Column]) -> Column:
    """For each unit of ref an array of its ops in every decode."""
    return align.unit_ops(ref, F.array(*decodes))


def band_counts(units: DataFrame, key: str, band: str, strict: bool) -> DataFrame:
    """Counts and percentage of green; amber is in the denominator of the strict mode alone."""
    g, r, a = (F.count_if(F.col(band) == x) for x in ("green", "red", "amber"))
    d = units.groupBy(key).agg(g.alias("green"), r.alias("red"), a.alias("amber"))
    total = F.col("green") + F.col("red") + (F.col("amber") if strict else F.lit(0))
    return d.withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("green"), total), F.lit(0.0)))


def collectable(counts: DataFrame, least: float = 90.0, judged: int = 3) -> DataFrame:
    return counts.where((F.col("percent") >= least) & (F.col("green") + F.col("red") >= judged))


def flag(word: Column, in_lexicon: Column, conf: Column, close: Column, split: Column, split_ok: Column, low: float = 0.55) -> Column:
    """Why a word is flagged: lowconf, split or typo; null if trusted.  Known confident words and short ones are."""
    typo = ~in_lexicon & ~(split & ~split_ok) & close
    return (
        F.when(in_lexicon & (conf >= low), F.lit(None).cast("string")).when(F.length(word) < 3, F.lit(None).cast("string")).when(conf < low, "lowconf").when(split & split_ok, "split").when(typo, "typo")
    )


def project_blind(candidates: DataFrame) -> DataFrame:
    """Of each word the candidate at the least distance, then of most frequency."""
    return candidates.groupBy("word").agg(F.min_by("cand", F.struct("dist", (-F.col("freq")).alias("f"), "cand")).alias("projected"))


def project_gated(candidates: DataFrame, score: str, own: str) -> DataFrame:
    """The candidate with the best score, if it beats the word's own score; else the word."""
    best = candidates.groupBy("word", own).agg(F.max_by("cand", F.struct(score, (-F.col("freq")).alias("f"), "cand")).alias("best"), F.max(score).alias("s"))
    return best.select("word", F.when(F.col("s") > F.col(own), F.col("best")).otherwise(F.col("word")).alias("projected"))


def compare_rankings(candidates: DataFrame, truth: str, score: str) -> DataFrame:
    """Top-1 and top-5 shares of the true candidate under two rankings, by its distance; 3 and more count as misses."""
    from pyspark.sql import Window

    w = Window.partitionBy("word")
    r = candidates.withColumns({"by_freq": F.row_number().over(w.orderBy("dist", F.desc("freq"), "cand")), "by_score": F.row_number().over(w.orderBy(F.desc(score), "cand"))})
    true = r.where(F.col("cand") == F.col(truth))
    share = lambda c, k: F.avg(((F.col(c) <= k) & (F.col("dist") < 3)).cast("int")).alias(f"{c}_top{k}")
    return true.groupBy("dist").agg(F.count("*").alias("n"), share("by_freq", 1), share("by_freq", 5), share("by_score", 1), share("by_score", 5))


def agreeing_runs(a: Column, b: Column, least: int = 3) -> Column:
    """(start, end) word places in a of runs of equal words of both systems."""
    equal = F.filter(align.word_opcodes(a, b), lambda c: (c["tag"] == "equal") & (c["i2"] - c["i1"] >= least))
    return F.transform(equal, lambda c: F.struct(c["i1"].alias("start"), c["i2"].alias("end")))


def gated_runs(pairs: DataFrame, keys: list[str], a: str, b: str, lexicon: DataFrame, seconds_per_word: float, confidence: str | None = None, least: int = 3, least_conf: float = 0.55, least_share: float = 0.60, pad: float = 0.1, shortest: float = 1.0, longest: float = 18.0) -> DataFrame:
    """Agreeing runs that may become labels: at least `least` equal words, a mean confidence (an array column, one value
    for each word of a; none: not asked) and a share of words in the lexicon that reach their bounds, and a span, padded
    and clamped to the recording, between `shortest` and `longest` seconds.

    Runs are cut into words that find the lexicon by a join, so a lexicon of any size will do."""
    w = words(F.col(a))
    own = [F.col(confidence).alias("conf")] if confidence else []
    runs = pairs.select(*keys, w.alias("w"), *own, F.explode(agreeing_runs(F.col(a), F.col(b), least)).alias("r"))
    runs = runs.select(*keys, F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.size("w").alias("n_words"), F.slice("w", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("run"), *(["conf"] if confidence else []))
    if confidence:
        part = F.slice("conf", F.col("start") + 1, F.col("end") - F.col("start"))
        runs = runs.where(F.aggregate(part, F.lit(0.0), lambda x, y: x + y) / F.size(part) >= least_conf).drop("conf")
    known = lexicon.select("word", F.lit(1).alias("known")).distinct()
    each = runs.select(*keys, "start", "end", "n_words", F.array_join("run", " ").alias("text"), F.explode("run").alias("word")).join(known, "word", "left")
    share = F.sum(F.coalesce("known", F.lit(0))) / F.count("*")
    out = each.groupBy(*keys, "start", "end", "n_words", "text").agg(share.alias("corpus_share")).where(F.col("corpus_share") >= least_share)
    total = F.col("n_words") * seconds_per_word
    out = out.withColumns({"from_s": F.greatest(F.col("start") * seconds_per_word - pad, F.lit(0.0)), "to_s": F.least(F.col("end") * seconds_per_word + pad, total)})
    return out.where((F.col("to_s") - F.col("from_s")).between(shortest, longest)).drop("n_words")
