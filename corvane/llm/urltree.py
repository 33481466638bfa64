r"""URL filter by a path-template tree, in DataFrame operations only.

Each host has a tree of path segments.  Runs of digits are generalised to `*` first, so the tree is made of distinct
shapes, however many paths they have.  Every prefix of a shape is a branch; all branches of all levels are summed up at once,
so the number of jobs does not follow the depth of paths.  Urls that a rule decides are the labelled ones.

What a branch holds, counted in paths, is its profile: its children by segment, those of a single path without a label as
one class `?`, and paths that end there.  A branch without labels looks like its labelled siblings, bad or good, if its
profile does not differ from their pooled one (chi-square test of homogeneity).  Branches are merged into `?+` where they
look like MERGE_BRANCHES labelled siblings or more, and labelled ones whose share of bad does not differ from that of their
labelled siblings (two-proportion test).  Other branches of a single path without a label are generalised to `?`, which no path
contains.  What remains is a template.

A template's purity is the share of bad among its labelled urls, smoothed towards what is known around it as if by SMOOTH
urls.  That is found along the path, from one half at the host: at each branch, the mean share of bad of the labelled siblings that
it looks like (of all other labelled ones, if it has labels itself), each weighing as much as its labelled urls allow, at
most one, is smoothed towards what the branch above has.  A branch's own urls never count for it there, and siblings
count as branches: one blocked section says little of the others however many urls it has, ten of one look decide.

All statistics are sums over distinct shapes, so a hot host, path or template is pre-aggregated before any shuffle.  Joins
of branches are left to the adaptive planner, which broadcasts tables that it finds small and splits skewed keys.  Verdicts come back by broadcast for the shapes that hold more
than one in BROADCAST_SHAPES of all urls, which are at most so many, and by shuffle for the rest, so no hot shape meets in
one task.

Defined cases: a null url, and one without `://`, has an empty host and path, is one shape without branches and is allowed
unless rules label it; very long urls are read whole, with work and rows in proportion to the square and the number of their
segments; repeated rows are judged alike and count each; ties cannot arise; an empty table gives no rows; columns of the
input named host, path, rule, verdict, template or purity give way to the operator's own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize

#: Labelled urls that both sides of a test of shares need, and the test's threshold in standard errors.
MERGE_LABELS, MERGE_ERRORS = 5, 1.64
#: Labelled siblings that a branch without labels must look like to be merged, and the test's threshold: chi-square up to
#: its mean and so many standard deviations.
MERGE_BRANCHES, ALIKE_DEVIATIONS = 10, 2.33
#: A template of this purity is rejected; the urls that smoothing counts for.
REJECT, SMOOTH = 0.9, 2
#: Verdicts of at most so many shapes are broadcast.
BROADCAST_SHAPES = 100_000
#: The tree of at most so many shapes is worked out by one task: its dozen joins and sums then need no shuffle.
ONE_TASK_SHAPES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host suffix and path prefix, written together like `example.net/en/`."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to / ? # with A-Z lower-cased; then up to ? #.  Both empty without one."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _branches(shapes: DataFrame) -> DataFrame:
    """One row for each prefix of each shape: (host, shape, d, node, parent, step, last) and the shape's numbers."""
    cut = lambda d: F.struct(F.array_join(F.slice("seg", F.lit(1), d), "/").alias("node"), F.array_join(F.slice("seg", F.lit(1), d - 1), "/").alias("parent"), F.element_at("seg", d).alias("step"), (d == F.size("seg")).alias("last"), d.alias("d"))
    every = F.transform(F.sequence(F.lit(1), F.size("seg")), cut)
    return shapes.where(F.size("seg") > 0).select("host", "shape", "paths", "urls", "bad", "good", F.inline(every))


def _profiles(nodes: DataFrame) -> DataFrame:
    """(host, parent, node, kind, c, n): how many paths each branch holds in each class of children; `/` is the end."""
    held = nodes.select("host", F.col("parent").alias("node"), F.when((F.col("own") == 0) & (F.col("paths") == 1), "?").otherwise(F.col("step")).alias("c"), F.col("paths").alias("n"))
    ends = nodes.where("ends > 0").select("host", "node", F.lit("/").alias("c"), F.col("ends").alias("n"))
    counted = held.where("node <> ''").unionByName(ends).groupBy("host", "node", "c").agg(F.sum("n").alias("n"))
    return counted.join(nodes.select("host", "parent", "node", "kind"), ["host", "node"])


def _evidence(nodes: DataFrame) -> DataFrame:
    """(host, node, alike, a, b): how many labelled siblings a branch looks like, the sum of their shares of bad, and of
    their weights; of a branch with labels, all its other labelled siblings."""
    labelled = nodes.where("own > 0")
    known = labelled.groupBy("host", "parent", "kind").agg(F.count("*").alias("m"), F.sum(F.col("weight") * F.col("share")).alias("s"), F.sum("weight").alias("w"))
    profiles = _profiles(nodes)
    pooled = profiles.where("kind is not null").groupBy("host", "parent", "kind", "c").agg(F.sum("n").alias("pn"))
    totals = pooled.groupBy("host", "parent", "kind").agg(F.sum("pn").alias("all_p"), F.count("*").alias("classes")).join(known, ["host", "parent", "kind"])
    met = profiles.where("kind is null").drop("kind").join(totals, ["host", "parent"]).join(pooled, ["host", "parent", "kind", "c"], "left").withColumn("pn", F.coalesce("pn", F.lit(0)))
    both = F.col("n") + F.col("pn")
    sums = met.groupBy("host", "node", "kind").agg(
        F.sum("n").alias("all_n"), F.sum("pn").alias("met_p"), F.count("*").alias("own_classes"), F.count_if(F.col("pn") > 0).alias("shared"), F.sum(F.col("n") * F.col("n") / both).alias("nn"),
        F.sum(F.col("n") * F.col("pn") / both).alias("np"), F.sum(F.col("pn") * F.col("pn") / both).alias("pp"), *(F.max(c).alias(c) for c in ("all_p", "classes", "m", "s", "w")),
    )
    ratio = F.col("all_n") / F.col("all_p")
    chi = F.col("nn") / ratio - 2 * F.col("np") + ratio * F.col("pp") + ratio * (F.col("all_p") - F.col("met_p"))
    freedom = F.col("own_classes") + F.col("classes") - F.col("shared") - 1
    alike = sums.where(chi <= freedom + ALIKE_DEVIATIONS * F.sqrt(2 * freedom) + 1e-9)
    without = alike.groupBy("host", "node").agg(F.sum("m").alias("alike"), F.sum("s").alias("a"), F.sum("w").alias("b"))
    siblings = known.groupBy("host", "parent").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("w").alias("w"))
    others = labelled.join(siblings, ["host", "parent"]).select("host", "node", (F.col("m") - 1).alias("alike"), (F.col("s") - F.col("weight") * F.col("share")).alias("a"), (F.col("w") - F.col("weight")).alias("b"))
    return without.unionByName(others)


def templates(shapes: DataFrame) -> DataFrame:
    """shapes: (host, shape, paths, urls, bad, good), distinct.  Adds template, the generalised shape, and above, what is
    known around it."""
    t = materialize(shapes.withColumn("seg", F.filter(F.split("shape", "/"), lambda s: s != "")), "shapes")
    few = t.count() <= ONE_TASK_SHAPES
    t = t.coalesce(1) if few else t
    nodes = _branches(t).groupBy("host", "parent", "node", "step").agg(*(F.sum(c).alias(c) for c in ("paths", "bad", "good")), F.sum(F.when(F.col("last"), F.col("paths")).otherwise(0)).alias("ends"))
    nodes = nodes.withColumn("own", F.col("bad") + F.col("good")).withColumn("share", F.try_divide("bad", "own")).withColumn("weight", F.col("own") / (F.col("own") + SMOOTH))
    nodes = materialize(nodes.withColumn("kind", F.when(F.col("share") >= 0.5, "bad").when(F.col("own") > 0, "good")), "nodes")
    nodes = nodes.coalesce(1) if few else nodes
    parents = nodes.groupBy("host", "parent").agg(F.sum("bad").alias("all_bad"), F.sum("own").alias("all_own"))
    rest = F.col("all_own") - F.col("own")
    pooled = F.try_divide("all_bad", "all_own")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("own")) + F.try_divide(F.lit(1.0), rest)))
    apart = F.abs(F.col("share") - F.try_divide(F.col("all_bad") - F.col("bad"), rest))
    same = F.coalesce((F.col("own") >= MERGE_LABELS) & (rest >= MERGE_LABELS) & (apart <= MERGE_ERRORS * error), F.lit(False))
    merged = F.when(F.col("own") > 0, same).otherwise(F.coalesce(F.col("alike") >= MERGE_BRANCHES, F.lit(False)))
    step = F.when(merged, "?+").when((F.col("own") == 0) & (F.col("paths") == 1), "?").otherwise(F.col("step"))
    decided = nodes.join(parents, ["host", "parent"]).join(_evidence(nodes), ["host", "node"], "left")
    decided = decided.select("host", "node", step.alias("general"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    levels = _branches(t).select("host", "shape", "node", "d").join(decided, ["host", "node"]).groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("d", "general", "a", "b"))).alias("path"))  # a path's levels
    out = t.join(levels, ["host", "shape"], "left")
    template = F.array_join(F.transform("path", lambda x: F.concat(F.lit("/"), x["general"])), "")
    above = F.aggregate("path", F.lit(0.5), lambda q, x: (x["a"] + SMOOTH * q) / (x["b"] + SMOOTH))
    return out.select("host", "shape", "paths", "urls", "bad", "good", F.coalesce(template, F.lit("")).alias("template"), F.coalesce(above, F.lit(0.5)).alias("above"))


def judge(pages: DataFrame, rules: tuple = RULES, url: str = "url", reject: float = REJECT) -> DataFrame:
    """pages with host, path, rule, verdict, template and purity (null for urls that a rule decides)."""
    host, path = parse(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "template", "purity")]
    given = "_given" + "_" * max([len(c) for c in kept], default=0)  # no column of pages has these names
    shape = "_shape" + given
    text, verdict = rule_of(host, path, rules)
    ruled = pages.select(*kept, host.alias("host"), path.alias("path"), text.alias("rule"), verdict.alias(given), F.regexp_replace(path, "[0-9]+", "*").alias(shape))
    count = lambda v: F.count(F.when(F.col(given) == v, 1))
    paths = ruled.groupBy("host", shape, "path").agg(F.count("*").alias("urls"), count("block").alias("bad"), count("allow").alias("good"))
    shapes = paths.groupBy("host", F.col(shape).alias("shape")).agg(F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in ("urls", "bad", "good")))
    tree = materialize(templates(shapes), "tree")
    scored = tree.groupBy("host", "template").agg(((F.sum("bad") + SMOOTH * F.max("above")) / (F.sum("bad") + F.sum("good") + SMOOTH)).alias("purity"))
    found = tree.select("host", F.col("shape").alias(shape), "template", "urls").join(scored, ["host", "template"])
    total = tree.agg(F.sum("urls")).first()[0] or 0
    if total <= BROADCAST_SHAPES:
        out = ruled.join(F.broadcast(found.drop("urls")), ["host", shape])
    else:
        # a shape with more than total / BROADCAST_SHAPES urls is one of at most BROADCAST_SHAPES
        found = materialize(found, "verdicts")
        often, seldom = found.where(F.col("urls") * BROADCAST_SHAPES > total).drop("urls"), found.where(F.col("urls") * BROADCAST_SHAPES <= total).drop("urls")
        out = ruled.join(F.broadcast(often), ["host", shape]).unionByName(ruled.join(F.broadcast(often), ["host", shape], "left_anti").join(seldom, ["host", shape]))
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*kept, "host", "path", "rule", F.coalesce(given, own).alias("verdict"), "template", F.when(F.col(given).isNull(), F.col("purity")).alias("purity"))


def op4(pages: DataFrame) -> DataFrame:
    """The contract's digest."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")
