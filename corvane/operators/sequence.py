"""Ordered semantics: run collapse, islands, merges, windows, running quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import let


def collapse_runs(frames: DataFrame, unit: str, order: str, symbol: str, blank: Column | None = None) -> DataFrame:
    """Drops a frame that repeats the one before it; blanks go after that comparison, so they separate repeats."""
    prev = F.lag(symbol).over(Window.partitionBy(unit).orderBy(order))
    kept = frames.withColumn("_p", prev).where(F.col("_p").isNull() | (F.col("_p") != F.col(symbol))).drop("_p")
    return kept if blank is None else kept.where(~blank)


def islands(frames: DataFrame, unit: str, order: str, starts: Column) -> DataFrame:
    """Adds island, counted from 1 at each row that starts one (rows before the first: island 0)."""
    w = Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("island", F.sum(starts.cast("int")).over(w))


def spans(frames: DataFrame, unit: str, order: str, *aggs: Column) -> DataFrame:
    """One row for each island: its first place, and the next one's first place (null for the last)."""
    g = frames.groupBy(unit, "island").agg(F.min(order).alias("start"), *aggs)
    return g.withColumn("end", F.lead("start").over(Window.partitionBy(unit).orderBy("island")))


def merge_segments(cuts: Column, least: float = 4.0, most: float = 16.0, sliver: float = 0.2) -> Column:
    """Sorted cut points to (start, end) segments: slivers go, short ones grow greedily, long ones split evenly."""
    between = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.get(c, i - 1).alias("s"), F.get(c, i).alias("e")))
    raw = let(cuts, lambda c: F.when(F.size(c) >= 2, between(c)).otherwise(F.array().cast("array<struct<s:double,e:double>>")))
    raw = F.filter(raw, lambda x: x["e"] - x["s"] > sliver)
    none = F.array().cast("array<struct<s:double,e:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), x["e"].alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(last["e"] - last["s"] < least, grown).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(raw, none, step)

    def parts(x: Column) -> Column:
        length = x["e"] - x["s"]
        k = F.greatest(F.ceil(length / most), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((x["s"] + i * (length / k)).alias("s"), (x["s"] + (i + 1) * (length / k)).alias("e")))

    return F.flatten(F.transform(merged, parts))


def silence_cuts(silences: Column, duration: Column) -> Column:
    """Midpoints of silences with both ends of the recording, rounded to 3 places, distinct and sorted."""
    mid = F.transform(silences, lambda x: (x["s"] + x["e"]) / 2)
    every = F.transform(F.concat(F.array(F.lit(0.0)), mid, F.array(duration)), lambda c: F.round(c, 3))
    return F.array_sort(F.array_distinct(F.filter(every, lambda c: (c >= 0) & (c <= duration))))


def fixed_windows(duration: Column, width: float = 28.0, tail: float = 4.0) -> Column:
    """(start, end) windows of a width; a tail shorter than `tail` joins the last window."""
    n = F.greatest(F.ceil(duration / width), F.lit(1)).cast("int")
    n = F.when((n > 1) & (duration - (n - 1) * width < tail), n - 1).otherwise(n)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * width).cast("double").alias("s"), F.when(i == n - 1, duration).otherwise((i + 1) * width).cast("double").alias("e")))


def running_quota(events: DataFrame, key: str, ts: str, tie: str, limit: int) -> DataFrame:
    """The n-th event of each key and day is allowed up to the limit; remaining is what is left after it."""
    day = F.to_date(ts)
    n = F.row_number().over(Window.partitionBy(key, "day").orderBy(ts, tie))
    q = events.withColumn("day", day).withColumn("nth", n)
    return q.withColumns({"allowed": F.col("nth") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("nth"), F.lit(0))})


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Adds session: a new one after a gap longer than the given seconds."""
    w = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    apart = micros - F.lag(micros).over(w) > gap_seconds * 1_000_000
    e = events.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    return e.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def locked_prefix(partials: Column, volatile: int = 3) -> Column:
    """Words committed by a sequence of partial hypotheses (arrays of words): all but the last few of each lock, and
    locked words never change."""
    none = F.array().cast("array<string>")
    grow = lambda acc, p: F.concat(acc, F.slice(p, F.size(acc) + 1, F.greatest(F.size(p) - volatile - F.size(acc), F.lit(0))))
    return F.aggregate(partials, none, grow)


def shifted_pairs(df: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    """Each row with the next row's value; the last wraps around to the first of its group."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(f"next_{value}", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def collision_suffix(df: DataFrame, name: str, *order: str) -> DataFrame:
    """The second and later rows of a name get -2, -3, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws("-", name, "_n"))).drop("_n")


def numbering(df: DataFrame, value: str) -> DataFrame:
    """Distinct characters of a text column with ids in order, from 0: a closed set of at most the code points in use."""
    symbols = df.select(F.explode(F.filter(F.array_distinct(F.split(value, "")), lambda x: x != "")).alias("symbol")).distinct()
    return symbols.withColumn("id", F.row_number().over(Window.orderBy("symbol")) - 1)


def grid_shift(left: DataFrame, right: DataFrame, key: str, grid: Column) -> DataFrame:
    """The constant time shift of each key that makes most left intervals (s, e) overlap right ones; the smallest of
    equals.  Intervals meet in cells of time as wide as the key's mean interval, so that all of them together lie in at most
    twice as many cells as there are intervals, however long some are; a pair counts in the first cell that both are in."""
    size = lambda df: df.select(key, (F.col("e") - F.col("s")).alias("size"))
    mean = size(left).unionByName(size(right)).groupBy(key).agg(F.avg("size").alias("width")).withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(1.0))
    cell = lambda c: F.floor(F.col(c) / F.col("width"))
    l = left.join(mean, key).withColumn("delta", F.explode(grid)).select(key, "width", "delta", (F.col("s") + F.col("delta")).alias("ls"), (F.col("e") + F.col("delta")).alias("le"))
    near = l.select(key, "delta", "ls", "le", cell("ls").alias("lc"), F.explode(F.sequence(cell("ls"), cell("le"))).alias("cell"))
    r = right.join(mean, key).select(key, "width", F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = near.join(r.select(key, "rs", "re", cell("rs").alias("rc"), F.explode(F.sequence(cell("rs"), cell("re"))).alias("cell")), [key, "cell"]).where("cell = greatest(lc, rc)")
    overlap = F.greatest(F.least("le", "re") - F.greatest("ls", "rs"), F.lit(0.0))
    found = pairs.groupBy(key, "delta").agg(F.sum(overlap).alias("overlap"))
    both = left.select(key).distinct().join(right.select(key).distinct(), key).select(key, F.explode(grid).alias("delta"), F.lit(0.0).alias("overlap"))
    per = found.unionByName(both).groupBy(key, "delta").agg(F.sum("overlap").alias("overlap"))
    return per.groupBy(key).agg(F.max_by("delta", F.struct("overlap", (-F.col("delta")).alias("d"))).alias("delta"), F.max("overlap").alias("overlap"))


def shift_search(left: DataFrame, right: DataFrame, key: str, reach: float, coarse: float = 5.0, fine: float = 1.0, at: float = 0.8) -> DataFrame:
    """(key, delta, overlap, valid): the shift by a coarse grid within `reach`, then a fine one around the best; valid if
    the left interval at a share `at` of the key's order, shifted, overlaps a right one."""
    steps = lambda low, high, step: F.transform(F.sequence(F.lit(0), F.floor((high - low) / step).cast("int")), lambda i: low + i * F.lit(step))
    rough = grid_shift(left, right, key, steps(F.lit(-reach), F.lit(reach), coarse)).select(key, F.col("delta").alias("rough"))
    near = left.join(rough, key)
    moved = near.select(key, (F.col("s") + F.col("rough")).alias("s"), (F.col("e") + F.col("rough")).alias("e"))
    best = grid_shift(moved, right, key, steps(F.lit(-coarse), F.lit(coarse), fine)).join(rough, key)
    best = best.select(key, (F.col("rough") + F.col("delta")).alias("delta"), "overlap")
    order = Window.partitionBy(key).orderBy("s", "e")
    ranked = left.withColumn("_n", F.row_number().over(order) - 1).join(left.groupBy(key).agg(F.count("*").alias("_all")), key)
    block = ranked.where(F.col("_n") == F.least(F.floor(F.col("_all") * at), F.col("_all") - 1)).select(key, F.col("s").alias("bs"), F.col("e").alias("be")).join(best, key)
    hit = block.join(right, key).where((F.col("bs") + F.col("delta") < F.col("e")) & (F.col("s") < F.col("be") + F.col("delta"))).select(key, F.lit(True).alias("hit")).distinct()
    return best.join(hit, key, "left").select(key, "delta", "overlap", F.coalesce("hit", F.lit(False)).alias("valid"))
