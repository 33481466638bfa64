r"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words.  Sources, ordered by code point with null last, weigh `ratios` in turn and
share the budget (a share of all sizes); a target stops at `cap` times its source's size, and the excess is shared
again by weight.  Each document draws an exponential key divided by its quality weight, so that sorting by the key is
weighted sampling without replacement.  A source takes as many complete epochs as its target holds, then documents in
key order while the running size comes nearer to the rest.

Running sizes are prefix sums over keys.  Keys are dealt into buckets in key order (about BUCKET_ROWS documents each,
by the distribution that the keys have), bucket totals are summed up per source, and only the inside of each bucket is
sorted, so a source with any share of all rows is spread over many tasks.

Defined cases: a null or empty text has size 0 and is taken with 0 words; a null source is a source; repeated rows are
documents of their own, ordered by key, id and size, which are the ties; very long texts are counted whole and taken
whole, so a source may miss its target by half of one; an empty table gives no rows; the key and the source alone are
carried along, so no other column can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, materialize

RATIOS = (1, 2, 3)
CAP = 3
BUCKET_ROWS = 1000
#: Source tables of at most so many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 20_000
SYMBOL = r"[#*$%&|<>{}\[\]!]"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """Words over words and symbols, from 0 to 1: the default document quality weight."""
    return (size + 1) / (size + 1 + F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)))


def unit(key: Column, seed: str) -> Column:
    """A repeatable draw from (0, 1] for each id: 52 bits of a digest of the id and the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))


def targets(sources: DataFrame, ratios: tuple = RATIOS, cap: int = CAP, budget: float = 1.0) -> DataFrame:
    """(src, source_size) with target: weights shared out, targets above the cap cut and the excess shared again.
    Sorted by size over weight, a source is capped if its part of what the sources before it leave is above its cap."""
    whole = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("src")
    weight = F.element_at(F.array(*(F.lit(r) for r in ratios)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(ratios))) + 1).cast("int")).cast("bigint")
    s = sources.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("all", F.sum("source_size").over(whole).cast("double") * budget).withColumn("all_w", F.sum("w").over(whole))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("used_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", (F.col("all") - F.col("used")) / (F.col("all_w") - F.col("used_w")).cast("double") * F.col("w") > F.col("most"))
    s = s.withColumn("cut", F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(whole), F.lit(0))).withColumn("cut_w", F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(whole), F.lit(0)))
    part = (F.col("all") - F.col("cut")) / (F.col("all_w") - F.col("cut_w")).cast("double") * F.col("w")
    return s.select("src", "docs", "mean", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(part).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weight: Column | None = None, ratios: tuple = RATIOS, cap: int = CAP, budget: float = 1.0, seed: str = "mix", drawn_by: Column | None = None) -> DataFrame:
    """One row per document: key, source, size, source_size, target, epochs (times taken) and taken (words taken).
    `weight`: the quality weight, above 0; by default from the text.  `drawn_by`: what a draw is made from; by default
    the key."""
    size = word_count(F.col(text))
    draw = unit(F.col(key) if drawn_by is None else drawn_by, seed)
    sized = docs.select(key, source, size.alias("size"), (quality_weight(F.col(text), size) if weight is None else weight).cast("double").alias("quality"), draw.alias("unit"))
    src = F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))  # null after every name
    sized = materialize(sized.withColumn("src", src).withColumn("draw", -F.log("unit") / F.greatest("quality", F.lit(1e-9))).drop("unit"), "sized")

    sources = sized.groupBy("src").agg(F.count("*").alias("docs"), F.avg("quality").alias("mean"), F.sum("size").alias("source_size"))
    goals = materialize(targets(sources, ratios, cap, budget), "targets")
    few = goals.count() <= BROADCAST_ROWS
    fitted = lambda df: F.broadcast(df) if few else df

    buckets = F.ceil(F.col("docs") / F.lit(BUCKET_ROWS)).cast("bigint")
    placed = sized.join(fitted(goals), "src").withColumn("bucket", F.least(buckets - 1, F.floor(buckets * (1 - F.exp(-F.col("draw") * F.col("mean"))))))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("src", "bucket", F.coalesce(earlier, F.lit(0)).alias("offset"))
    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("draw", key, "size").rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["src", "bucket"])

    full = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")
    rest = F.col("target") - F.col("full") * F.col("source_size")
    more = (2 * (F.col("offset") + F.col("inside")) + F.col("size") <= 2 * rest).cast("bigint")
    out = ranked.withColumn("full", full).withColumn("epochs", F.least(F.col("full") + more, F.lit(cap)))
    return out.select(key, source, "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it.  `key` must be a row's own: rows that share one
    share its times, and a null key finds none."""
    times = mixed.where("epochs > 0").groupBy(key).agg(F.max("epochs").alias("_times"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    return docs.join(times, key).withColumn("_copy", copies).drop("_times", "_copy")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>{}\[\]!]')), 0)::BIGINT AS symbols
  FROM documents),
drawn AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)
            / ((size + 1)::DOUBLE / (size + 1 + symbols)) AS draw
  FROM sized),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM drawn GROUP BY src),
s1 AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS most, sum(source_size) OVER ()::DOUBLE AS total FROM s),
s2 AS (SELECT *, (sum(w) OVER ())::BIGINT AS total_w,
              coalesce(sum(most) OVER q, 0)::BIGINT AS used, coalesce(sum(w) OVER q, 0)::BIGINT AS used_w
       FROM s1 WINDOW q AS (ORDER BY source_size::DOUBLE / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - used) / (total_w - used_w)::DOUBLE * w > most AS capped FROM s2),
s4 AS (SELECT *, coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0)::BIGINT AS cut, coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0)::BIGINT AS cut_w FROM s3),
goals AS (SELECT src, source_size, CASE WHEN capped THEN most::DOUBLE ELSE (total - cut) / (total_w - cut_w)::DOUBLE * w END AS target FROM s4),
ranked AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(floor(g.target / nullif(g.source_size, 0)), 0)::BIGINT AS full_,
         coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM drawn d JOIN goals g ON d.src = g.src)
SELECT doc_id, size, source_size, target,
       least(full_ + CASE WHEN 2 * before + size <= 2 * (target - full_ * source_size) THEN 1 ELSE 0 END, 3) * size AS taken
FROM ranked
"""
