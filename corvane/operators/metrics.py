"""Error metrics over (reference, hypothesis) pairs and their reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import align, edit
from corvane.functions.align import anchor
from corvane.functions.text import words
from corvane.operators.curate import ranked_sum
from corvane.sources.sinks import kept

# Character classes of the substitution taxonomy, in order of precedence.
TAXONOMY = (
    ("nasal", ("ंँङञणनम",)),
    ("sibilant", ("शषस",)),
    ("retroflex_dental", ("नण", "तट", "थठ", "दड", "धढ", "सष")),
    ("voicing_aspiration", ("कखगघ", "चछजझ", "टठडढ", "तथदध", "पफबभ")),
    ("vowel_length", ("अआ", "इई", "उऊ", "ऋॠ", "िी", "ुू", "ेै", "ोौ")),
)


def with_edits(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Adds char_edits, char_len (spaces do not count), word_edits, word_len and the hypothesis' lengths."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return pairs.withColumns({
        "char_edits": edit.char_edits(bare(ref), bare(hyp)), "char_len": F.length(bare(ref)), "hyp_chars": F.length(bare(hyp)),
        "word_edits": edit.word_edits(F.col(ref), F.col(hyp)), "word_len": F.size(words(F.col(ref))), "hyp_words": F.size(words(F.col(hyp))),
    })


def micro(edits: DataFrame, *by: str, empty_ref: str = "accumulate") -> DataFrame:
    """Sum of edits over sum of lengths for each group; with two or more levels use `rollup_micro` for the totals too."""
    if empty_ref == "skip":
        edits = edits.where("char_len > 0")
    return _rates(edits.groupBy(*by))


def rollup_micro(edits: DataFrame, *by: str) -> DataFrame:
    return _rates(edits.rollup(*by))


def _rates(grouped) -> DataFrame:
    sums = grouped.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("char_edits", "char_len", "word_edits", "word_len")))
    return sums.withColumns({"cer": F.try_divide("char_edits", "char_len"), "wer": F.try_divide("word_edits", "word_len")})


def sn_wer(pairs: DataFrame, *by: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Segmentation-free word error rate, lenient to strict, and the share of the word error rate due to segmentation."""
    p = pairs.withColumn("s", align.spaceless(ref, hyp)).withColumn("w", edit.word_edits(F.col(ref), F.col(hyp)))
    g = p.groupBy(*by).agg(F.sum("s.n_words").alias("n_words"), F.sum("s.bad_lenient").alias("lo"), F.sum("s.bad_strict").alias("hi"), F.sum("s.n_ins").alias("n_ins"), F.sum("w").alias("word_edits"))
    share = lambda c: F.try_divide(F.col("word_edits") - F.col(c), F.col("word_edits"))
    return g.withColumns({"sn_wer_lo": F.try_divide("lo", "n_words"), "sn_wer_hi": F.try_divide("hi", "n_words"), "segmentation_strict": share("hi"), "segmentation_lenient": share("lo")})


def position_errors(pairs: DataFrame, *by: str, ref: str = "ref", hyp: str = "hyp", last: int = 7) -> DataFrame:
    """Error rate of reference words by position; positions from `last` on count together."""
    ops = pairs.select(*by, F.explode(align.word_ops(ref, hyp)).alias("o")).where("o.op <> 'I'")
    return ops.groupBy(*by, F.least("o.ri", F.lit(last)).alias("position")).agg(F.count("*").alias("n"), F.sum((F.col("o.op") != "M").cast("int")).alias("errors")).withColumn("rate", F.col("errors") / F.col("n"))


def word_accuracy(pairs: DataFrame, *by: str, ref: str = "ref", hyp: str = "hyp", skip_first: int = 0) -> DataFrame:
    """Share of reference words matched exactly, and matched within one character; insertions do not count."""
    ops = pairs.select(*by, F.explode(align.word_ops(ref, hyp)).alias("o")).where((F.col("o.op") != "I") & (F.col("o.ri") >= skip_first))
    close = (F.col("o.op") == "M") | ((F.col("o.op") == "S") & (F.levenshtein("o.rc", "o.hc", 1) >= 0))
    return ops.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("o.op") == "M").cast("int")).alias("word_accuracy"), F.avg(close.cast("int")).alias("within_one"))


def char_ops(pairs: DataFrame, *by: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(op, rc, hc, n): counts of alignment operations by characters, counted within each pair first."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    counted = pairs.select(*by, F.explode(align.char_op_counts(bare(ref), bare(hyp))).alias("o"))
    return counted.groupBy(*by, "o.op", "o.rc", "o.hc").agg(F.sum("o.n").alias("n"))


def confusions(ops: DataFrame, *by: str) -> DataFrame:
    """Counts of substitutions and deletions by characters."""
    return ops.where("op in ('S', 'D')").groupBy(*by, "op", "rc", "hc").agg(F.sum("n").alias("count"))


def top(df: DataFrame, n: int, by: Column, *ties: str) -> DataFrame:
    """The first n rows of a report."""
    return df.orderBy(by, *ties).limit(n)


def category(rc: Column, hc: Column) -> Column:
    """The taxonomy's class of a substitution."""
    out = F.lit("other")
    for name, groups in reversed(TAXONOMY):
        hit = F.lit(False)
        for g in groups:
            hit = hit | (rc.isin(*g) & hc.isin(*g))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def breakdown(pairs: DataFrame, legacy_counts: bool = False, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Edit operations by class, with shares, from opcodes of the hypothesis against the reference.  legacy_counts leaves
    out pure insertions and deletions, counting only what replaced blocks have in excess."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    codes = pairs.select(bare(ref).alias("r"), bare(hyp).alias("h")).select("r", "h", F.explode(align.char_opcodes("h", "r")).alias("c")).where("c.tag <> 'equal'")
    # in opcodes of (hypothesis, reference) what is deleted was inserted by the system, and the other way round
    nh, nr = F.col("c.i2") - F.col("c.i1"), F.col("c.j2") - F.col("c.j1")
    both = F.when(F.col("c.tag") == "replace", F.least(nh, nr)).otherwise(0)
    subs = codes.where(both > 0).withColumn("k", F.explode(F.sequence(F.lit(1), both)))
    char = lambda c, at: F.substring(c, at + F.col("k"), F.lit(1))
    subs = subs.select(category(char(F.col("r"), F.col("c.j1")), char(F.col("h"), F.col("c.i1"))).alias("kind"), F.lit(1).alias("n"))
    rest = codes.where("c.tag = 'replace'") if legacy_counts else codes
    extra = rest.select(F.explode(F.array(F.struct(F.lit("insertion").alias("kind"), (nh - both).alias("n")), F.struct(F.lit("deletion").alias("kind"), (nr - both).alias("n")))).alias("e")).select("e.*")
    counts = subs.unionByName(extra).groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def single_substitutions(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """(rc, hc, n) of word pairs of one length that differ in exactly one character."""
    subs = pairs.select(F.explode(align.word_ops(ref, hyp)).alias("o")).where("o.op = 'S' and length(o.rc) = length(o.hc)")
    zipped = F.filter(F.arrays_zip(F.split("o.rc", "").alias("r"), F.split("o.hc", "").alias("h")), lambda x: x["r"] != x["h"])
    return subs.select(zipped.alias("d")).where("size(d) = 1").select(F.col("d")[0]["r"].alias("rc"), F.col("d")[0]["h"].alias("hc")).groupBy("rc", "hc").agg(F.count("*").alias("n"))


def unlike_words(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", n: int = 40) -> DataFrame:
    """Replaced word pairs ranked by how many of their substitutions are of no phonetic class."""
    subs = pairs.select(F.explode(align.word_ops(ref, hyp)).alias("o")).where("o.op = 'S'").select("o.rc", "o.hc").groupBy("rc", "hc").count()
    ops = subs.withColumn("o", F.explode(align.char_ops("rc", "hc"))).where("o.op = 'S'")
    other = F.sum((category(F.col("o.rc"), F.col("o.hc")) == "other").cast("int")).alias("other")
    ranked = ops.groupBy("rc", "hc", "count").agg(other).withColumn("share", F.least(F.col("other") / F.greatest(F.length("rc"), F.lit(1)), F.lit(1.0)))
    return top(ranked.where("other > 0"), n, F.desc("other"), "rc", "hc")


def family_recall(ops: DataFrame, family: str, *by: str) -> DataFrame:
    """Matched share of a class of reference characters, and the hypothesis' number of them over the reference's."""
    r, h = F.col("rc").isin(*family), F.col("hc").isin(*family)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = ops.groupBy(*by).agg(n(r).alias("ref_n"), n(r & (F.col("op") == "M")).alias("matched"), n(h).alias("hyp_n"))
    return g.withColumns({"recall": F.try_divide("matched", "ref_n"), "over_insertion": F.try_divide("hyp_n", "ref_n")})


def anchored(segments: DataFrame, references: DataFrame, key: str, order: str, hyp: str, ref: str) -> DataFrame:
    """Each segment's span of its recording's reference (one row in references) and the character error rate.  One
    recording's segments meet its reference in a task: the alignment is of all of them together."""
    kinds = {c: segments.schema[c].dataType.simpleString() for c in (key, order)}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by(order)
        text = right[ref].to_pylist()
        spans = anchor([h or "" for h in left[hyp].to_pylist()], (text[0] if text else None) or "")
        return pa.table({key: left[key], order: left[order], "span": pa.array([s for s, _ in spans], pa.string()), "cer": pa.array([c for _, c in spans], pa.float64())})

    grouped = segments.select(key, order, hyp).groupBy(key).cogroup(references.select(key, ref).groupBy(key))
    return grouped.applyInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, span string, cer double")


def exact_percentiles(df: DataFrame, value: str, points: list[float], *by: str) -> DataFrame:
    """(by, p): an array of the linearly interpolated percentiles of each group.  Values are counted first; running counts
    are made in value ranges, so neither a group's values nor its distinct values meet in one task or buffer."""
    return _percentiles_of(value_counts(df, value, *by), points, *by)


def value_counts(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, v, n), written down before nulls are left out, so that values are made once."""
    return kept(df.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")), "values").where("v is not null")


def _percentiles_of(counts: DataFrame, points: list[float], *by: str) -> DataFrame:
    ranked = ranked_sum(counts, "n", "v", by=by)
    total = counts.groupBy(*by).agg(F.sum("n").alias("all"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by]
    j = ranked.alias("r").join(total.alias("a"), same) if by else ranked.alias("r").crossJoin(total.alias("a"))
    j = j.select(*(F.col(f"r.{c}").alias(c) for c in by), "v", "before", "n", "all")
    # the values at the two places around each percentile's place
    place = lambda p: (F.col("all") - 1) * F.lit(p)
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("v")))
    sides = [x for i, p in enumerate(points) for x in (at(F.floor(place(p))).alias(f"lo{i}"), at(F.ceil(place(p))).alias(f"hi{i}"))]
    found = j.groupBy(*by, "all").agg(*sides)
    mixed = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (place(p) - F.floor(place(p))) for i, p in enumerate(points)]
    return found.select(*by, F.array(*mixed).alias("p"))


def percentiles(df: DataFrame, value: str, points: tuple = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """Linearly interpolated percentiles and the mean."""
    counts = value_counts(df, value)
    p = _percentiles_of(counts, [x / 100 for x in points])
    return p.crossJoin(counts.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))).select(*(F.col("p")[i].alias(f"p{x}") for i, x in enumerate(points)), "mean")


def bucket(c: Column, edges: tuple) -> Column:
    """Half-open buckets by their lower edge; below the first is null."""
    out = F.lit(None).cast("double")
    for e in edges:
        out = F.when(c >= e, F.lit(float(e))).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, edges: tuple) -> DataFrame:
    return df.groupBy(bucket(F.col(value), edges).alias("lower")).agg(F.count("*").alias("n"))


def best_and_worst(df: DataFrame, rate: str, key: str, best: int = 4, worst: int = 6) -> DataFrame:
    one = lambda order, n, tag: df.orderBy(order, key).limit(n).withColumn("side", F.lit(tag))
    return one(F.desc(rate), worst, "worst").unionByName(one(F.asc(rate), best, "best"))


def auc(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Rank-sum area under the curve without tie correction; ties rank positives first, then by key.  Ranks come from
    counts below each distinct score, summed in ranges of scores, so no global sort meets in one task."""
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n"))
    # positives of one score hold ranks below .. below + p - 1
    ranks = ranked_sum(per, "n", score).withColumnRenamed("before", "below").agg(F.sum(F.col("p") * F.col("below") + F.col("p") * (F.col("p") - 1) / 2).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return ranks.select(((F.col("r") - F.col("p") * (F.col("p") - 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"), F.col("p").alias("positives"), (F.col("n") - F.col("p")).alias("negatives"))


def threshold_at_fpr(df: DataFrame, score: str, label: str, rate: float) -> DataFrame:
    """The score at a false positive rate (label 0 is good, low scores are flagged), the recall there and the rate
    realised."""
    cut = exact_percentiles(df.where(F.col(label) == 0), score, [rate]).select(F.col("p")[0].alias("threshold"))
    flagged = (F.col(score) < F.col("threshold")).cast("int")
    return df.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.avg(F.when(F.col(label) == 1, flagged)).alias("recall"), F.avg(F.when(F.col(label) == 0, flagged)).alias("fpr"))


def oracle(df: DataFrame, systems: list[str], length: str) -> DataFrame:
    """Micro rates of each system and of the row-wise best of all."""
    best = F.least(*systems) if len(systems) > 1 else F.col(systems[0])
    return df.agg(*(F.try_divide(F.sum(s), F.sum(length)).alias(s) for s in systems), F.try_divide(F.sum(best), F.sum(length)).alias("oracle"))


def wins(df: DataFrame, a: str, b: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    x, y = F.col(a), F.col(b)
    return df.agg(n(x < y).alias("a_wins"), n(x > y).alias("b_wins"), n(x == y).alias("ties"), n((x == 0) & (y == 0)).alias("both_perfect"))
