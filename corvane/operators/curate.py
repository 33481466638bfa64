"""Curation: gates, compaction, samples, caps, splits, mixes and hard-example mining."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType

from corvane.functions.text import degenerate, let, low_variety, words
from corvane.sources.sinks import kept


# ------------------------------------------------------------------ gates


def first_failing(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that fails (null counts as failing); null if all pass."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(tests):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def gate(df: DataFrame, *tests: tuple[str, Column]) -> DataFrame:
    """Adds reason: why a row is out, null for rows that stay."""
    return df.withColumn("reason", first_failing(*tests))


def tri_state(score: Column, ok: Column, keep: float, retain: float) -> Column:
    """kept, retained or discarded, by a score with a soft ceiling."""
    return F.when(~F.coalesce(ok, F.lit(False)), "discarded").when(score <= keep, "kept").when(score <= retain, "retained").otherwise("discarded")


def pseudo_label_gate(df: DataFrame, conf: str, disagreement: str, least_conf: float = 0.90, most: float = 0.10) -> DataFrame:
    return gate(df, ("lowconf", F.col(conf) >= least_conf), ("disagree", F.col(disagreement) <= most))


def content_gate(text: Column, least_words: int = 3) -> Column:
    return F.size(words(text)) >= least_words


# ------------------------------------------------------------------ compaction, joins, splits


def last_write_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest record of each key.  max_by aggregates map-side, so one busy key is not gathered in a task."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def compact_labels(log: DataFrame, key: str, order: list[str], text: str = "text", unclear: str | None = None) -> DataFrame:
    """Last write wins, and only then the validity filter: non-empty, not the unclear sentinel, not flagged unclear."""
    last = last_write_wins(log, [key], order)
    ok = (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.col(text) != "[x]")
    return last.where(ok & ~F.coalesce(F.col(unclear), F.lit(False)) if unclear else ok)


def patched(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Overrides replace the columns that they name, where not null."""
    columns = [c for c in overrides.columns if c != key and c in df.columns]
    o = overrides.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = df.join(o, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def split_by_list(df: DataFrame, column: str, held: list[str]) -> DataFrame:
    return df.withColumn("split", F.when(F.col(column).isin(*held), "eval").otherwise("train"))


def split_by_top(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Group-disjoint split: the k largest groups are held out; ties by name."""
    held = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(k).select(F.col(column).alias("_held"))
    joined = df.join(F.broadcast(held), df[column].eqNullSafe(held["_held"]), "left")  # k rows
    return joined.withColumn("split", F.when(F.col("_held").isNotNull(), "eval").otherwise("train")).drop("_held")


# ------------------------------------------------------------------ samples and budgets


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n of each group.  Spark limits each partition by group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= n)


def systematic(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """Every k-th of a group with k = max(1, size // n), the first n of those."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.greatest(F.floor(F.count("*") / n), F.lit(1)).alias("step"))
    d = row_numbers(df, group, *order).join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return d.where(((F.col("rn") - 1) % F.col("step") == 0) & (F.floor((F.col("rn") - 1) / F.col("step")) < n)).drop("step")


def budget_prefix(df: DataFrame, amount: str, cap: float, *order: str, group: list[str] | None = None) -> DataFrame:
    """Rows in order while the sum before them is below the cap: the crossing row stays.  With no group the running sum
    is taken over range partitions in order, so rows do not all meet in one task."""
    if group:
        before = F.sum(amount).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap)
    return ranked_sum(df, amount, *order).where(F.col("before") < cap)


#: Rows that one task sorts at most, about, to sum or number them; tables of so many ranges are broadcast.
SPAN, BROADCAST_RANGES = 100_000, 10_000


def running(df: DataFrame, sums: dict[str, Column], *order: str, by: tuple = (), span: int = SPAN) -> DataFrame:
    """Adds, under each name, the sum of a column over the rows earlier in the order (of the same `by`, nulls being one
    value).  Up to `span` rows are summed by a window.  More are dealt into ranges of `by` and the order, of about `span`
    rows each however the rows are spread, since a row number breaks ties; the ranges are written down, so that they stay what
    they are when an executor is lost.  Sums of whole ranges come first, then those inside each."""
    n = df.count()
    if n <= span:
        before = Window.partitionBy(*by or (F.lit(0),)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})
    ranges = -(-n // span)
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *by, *order, "_tie").withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt, "ranges")
    whole = dealt.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_of_{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*by or (F.lit(0),)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range and group
    offsets = whole.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_of_{name}").over(earlier), F.lit(0)).alias(f"_of_{name}") for name in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({f"_in_{name}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = summed.join(offsets if by or ranges > BROADCAST_RANGES else F.broadcast(offsets), same)
    return joined.select(*df.columns, *((F.col(f"_of_{name}") + F.col(f"_in_{name}")).alias(name) for name in sums))


def ranked_sum(df: DataFrame, amount: str, *order: str, by: tuple = (), span: int = SPAN) -> DataFrame:
    """Adds before, the sum of the rows earlier in the order (of the same `by`)."""
    return running(df, {"before": F.col(amount)}, *order, by=by, span=span)


def row_numbers(df: DataFrame, group: str, *order: str, name: str = "rn") -> DataFrame:
    """Adds the number of each row in its group, from 1, by a running count over ranges of the order."""
    return running(df, {name: F.lit(1)}, *order, by=(group,)).withColumn(name, F.col(name).cast("bigint") + 1)


def round_robin(df: DataFrame, group: str, amount: str, target: float | Column, *order: str, within: list[str] | None = None) -> DataFrame:
    """One item of each group in turn, larger groups first, until the amounts reach the target; a null group is a group.
    With `within`, so in each of its values.  No row can be taken that its own group's earlier rows bring to the target, so the
    rest is cut off before the turns are put in order."""
    outer, target = within or [], target if isinstance(target, Column) else F.lit(float(target))
    keys = [*outer, group]
    place = F.row_number().over(Window.partitionBy(*outer, F.lit(0)).orderBy(F.desc("_n"), group))  # one row a group
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_place", place).select(*(F.col(c).alias(f"_g_{c}") for c in keys), "_place")
    numbered = running(df, {"turn": F.lit(1), "_own": F.col(amount)}, *order, by=tuple(keys)).where(F.col("_own") < target)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    dealt = numbered.join(sizes, same).select(*df.columns, (F.col("turn").cast("bigint") + 1).alias("turn"), "_place")
    return ranked_sum(dealt, amount, "turn", "_place", by=tuple(outer)).where(F.col("before") < target).drop("_place")


def per_group_caps(df: DataFrame, group: str, inner: str, amount: str, caps: dict, default: float, *order: str) -> DataFrame:
    """Round robin within each group up to its cap; a group with cap 0 is held out whole, a null group has the default.
    Adds split."""
    cap = F.lit(float(default))
    for name, value in caps.items():
        cap = F.when(F.col(group) == name, F.lit(float(value))).otherwise(cap)
    held = df.where(cap == 0).withColumn("split", F.lit("eval"))
    dealt = round_robin(df.where(cap > 0).withColumn("_cap", cap), inner, amount, F.col("_cap"), *order, within=[group])
    return dealt.drop("turn", "before", "_cap").withColumn("split", F.lit("train")).unionByName(held)


def hash_sample(df: DataFrame, group: str, n: int, key: Column, tie: str) -> DataFrame:
    """n of each group in a repeatable pseudo-random order."""
    return top_per_group(df, group, n, key, F.col(tie))


def shuffled_place(place: Column, n: int, seed: int = 7, rounds: int = 6) -> Column:
    """The place that row `place` (0 .. n - 1) has in a seeded shuffle of n rows, by itself: a Feistel network over a grid of
    a columns and b rows with a * b >= n > a * b - a, walked on while it leads beyond n.  Fewer than a cells of the grid lie
    there, so a walk takes that many steps more at most; after WALK of them the result is -1 (see `shuffled`)."""
    a = max(1, math.isqrt(n - 1) + 1) if n else 1
    b = max(1, -(-n // a))

    def mixed(x: Column, k: Column, modulus: int) -> Column:
        """A draw from 0 .. modulus - 1 for each x below 2**31."""
        y = (x * 1_103_515_245 + (k * 12_345 + (seed * 40_503 + 1)) % (1 << 31)) % (1 << 31)
        y = (y.bitwiseXOR(F.shiftright(y, 15)) * 22_695_477 + 1) % (1 << 31)
        return F.shiftright(y, 5) % modulus

    def turn(s: Column, k: Column) -> Column:
        u = (s["u"] + mixed(s["v"], 2 * k, b)) % b
        return F.struct(u.alias("u"), ((s["v"] + mixed(u, 2 * k + 1, a)) % a).alias("v"))

    def once(x: Column) -> Column:
        cell = F.struct(F.call_function("div", x, F.lit(a).cast("bigint")).alias("u"), (x % a).alias("v"))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")), cell, turn, lambda s: s["u"] * a + s["v"])

    if not 0 < n < 1 << 62:
        return F.lit(None).cast("bigint")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, a))), once(place.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return let(walk, lambda x: F.when(x < n, x).otherwise(-1))


#: Steps that a walk takes in one expression.
WALK = 16


def shuffled(df: DataFrame, place: str, n: int, seed: int = 7, name: str = "shuffled") -> DataFrame:
    """Adds each row's place in a global shuffle, without sorting; `place` counts the n rows from 0.  For n of some hundreds
    or more a walk of over WALK steps has a chance below n ** -8; a row that needs one is an error, not lost."""
    got = shuffled_place(F.col(place), n, seed)
    sure = F.when(got < 0, F.raise_error(F.lit("a walk of the shuffle takes too long: choose another seed"))).otherwise(got)
    return df.withColumn(name, sure.cast("bigint"))


def every_kth(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Every k-th row of all, the first included."""
    return running(df, {"_before": F.lit(1)}, *order).where(F.col("_before") % k == 0).drop("_before")


def spread_top(df: DataFrame, group: str, start: str, score: str, n: int, gap: float) -> DataFrame:
    """Of each group the n with the highest score that start at least `gap` apart, taken greedily; then, if fewer were
    found, the highest left.  A group's rows pass in order of score and at most n chosen and n left ones are held, so a
    group can have any size."""
    kinds = {c: df.schema[c].dataType for c in (group, start, score)}
    schema = ", ".join(f"`{c}` {k.simpleString()}" for c, k in ((group, kinds[group]), ("pick", IntegerType()), (start, kinds[start]), (score, kinds[score]), ("backfill", BooleanType())))

    def picks(key, chosen: list, left: list) -> list:
        return [(key, i, t, s, i >= len(chosen)) for i, (t, s) in enumerate((chosen + left)[:n])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = names = None
        key, chosen, left, opened, out = None, [], [], False, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, fields, strict=True)], names=names)

        for b in batches:
            fields = [b.column(0).type, pa.int32(), b.column(1).type, b.column(2).type, pa.bool_()]
            names = [group, "pick", start, score, "backfill"]
            for k, t, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not opened or k != key:
                    if opened:
                        out += picks(key, chosen, left)
                    key, chosen, left, opened = k, [], [], True
                if len(chosen) == n:
                    continue
                if all(t is not None and y is not None and abs(y - t) >= gap for y, _ in chosen):
                    chosen.append((t, s))
                elif len(left) < n and (t, s) not in chosen:
                    left.append((t, s))
            if out:
                yield batch()
                out = []
        if opened:
            out += picks(key, chosen, left)
            yield batch()

    ordered = df.select(group, start, score).repartition(group).sortWithinPartitions(F.col(group), (-F.col(score)).asc_nulls_first(), F.col(start))
    return ordered.mapInArrow(run, schema)


def disagreement_band(df: DataFrame, dis: str, text: str, most: float = 0.90, least: float | None = None) -> DataFrame:
    """Drops total disagreement and low-variety text; a lower bound only on request."""
    kept = df.where((F.col(dis) <= most) & ~low_variety(F.col(text)))
    return kept if least is None else kept.where(F.col(dis) >= least)


def z_hardness(df: DataFrame, *columns: str) -> DataFrame:
    """Adds z, the sum of population z-scores; the moments are one aggregate row, broadcast."""
    m = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    total = sum(((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9) for c in columns), F.lit(0.0))
    return df.crossJoin(F.broadcast(m)).withColumn("z", total).select(*df.columns, "z")


def band_report(df: DataFrame, group: str, score: str, dis: str, key: str, lo: float = 0.55, hi: float = 0.62, most: float = 0.90) -> DataFrame:
    """Inspection report: the hardest 6, the first 3 inside a band, and the totals."""
    pick = lambda d, tag: d.select(F.lit(tag).alias("part"), F.col(key).cast("string").alias("key"), F.col(dis).alias("value"))
    hard = pick(df.orderBy(F.desc(score), key).limit(6), "hardest")
    band = pick(df.where(F.col(dis).between(lo, hi)).orderBy(key).limit(3), "band")
    totals = df.agg(F.count_if(F.col(dis) > most).cast("double").alias("excluded"), (F.count("*") / F.count_distinct(group)).alias("per_group"))
    stats = totals.select(F.explode(F.create_map(F.lit("excluded"), "excluded", F.lit("per_group"), "per_group")).alias("key", "value")).select(F.lit("total").alias("part"), "key", "value")
    return hard.unionByName(band).unionByName(stats)


# ------------------------------------------------------------------ mixes and reports


def union_tagged(**tables: DataFrame) -> DataFrame:
    out = None
    for tag, df in tables.items():
        one = df.withColumn("origin", F.lit(tag))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def composition(df: DataFrame, by: str, amount: str) -> DataFrame:
    """Amount, rows and share of each group, with a TOTAL row."""
    r = df.rollup(by).agg(F.sum(amount).alias("amount"), F.count("*").alias("n"), F.grouping(by).alias("g"))
    total = F.sum(F.when(F.col("g") == 1, F.col("amount"))).over(Window.partitionBy(F.lit(0)))
    return r.select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col(by)).alias(by), "amount", "n", (F.col("amount") / total).alias("share"))


def yield_report(df: DataFrame, by: str, amount: str, kept: Column) -> DataFrame:
    """Kept against raw, with floored denominators."""
    g = df.groupBy(by).agg(F.sum(amount).alias("raw"), F.sum(F.when(kept, F.col(amount)).otherwise(0)).alias("kept"), F.count("*").alias("n"), F.count_if(kept).alias("n_kept"))
    return g.withColumns({"yield": F.col("kept") / F.greatest("raw", F.lit(0.01)), "row_yield": F.col("n_kept") / F.greatest("n", F.lit(1))})


def threshold_sweep(df: DataFrame, by: list[str], score: str, amount: str, thresholds: list[float], below: bool = True) -> DataFrame:
    """What each threshold would keep, in one scan: one conditional pair of aggregates for each."""
    ok = lambda t: F.col(score) <= t if below else F.col(score) >= t
    pairs = [a for i, t in enumerate(thresholds) for a in (F.count_if(ok(t)).alias(f"n{i}"), F.sum(F.when(ok(t), F.col(amount)).otherwise(0)).alias(f"a{i}"))]
    g = df.groupBy(*by).agg(*pairs)
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("amount")) for i, t in enumerate(thresholds)))
    return g.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def degenerate_rows(df: DataFrame, text: str) -> DataFrame:
    return df.where(degenerate(words(F.col(text))))


def matrix(df: DataFrame, configs: dict[str, Column], column: str, sets: list[str]) -> DataFrame:
    """One row for each configuration (a named test) and evaluation set (a value of a column): rows of the set and the
    share that passes.  The table is read once: each row counts for all configurations."""
    tests = F.array(*(F.struct(F.lit(name).alias("config"), ok.cast("int").alias("ok")) for name, ok in configs.items()))
    found = df.where(F.col(column).isin(*sets)).select(F.col(column).alias("eval_lang"), F.explode(tests).alias("t")).groupBy("t.config", "eval_lang").agg(F.count("*").alias("n"), F.avg("t.ok").alias("share"))
    grid = df.sparkSession.createDataFrame([(c, s) for c in configs for s in sets], "config string, eval_lang string")
    return grid.join(found, ["config", "eval_lang"], "left").select("config", "eval_lang", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))
