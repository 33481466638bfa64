"""Character language models: interpolated Kneser-Ney smoothing with three discounts, as DataFrames; and a packed trie
for models of a checked size.

Tokens are characters, a bar for a space; a text is framed by START and END, and grams are strings.  A gram of the highest
order, or one that begins with START, counts how often it occurs; any other counts the distinct characters before it.  So
each order is an aggregation of the one above it, and no order but the highest reads texts.

Defined cases: null and empty texts train nothing and have no score (null); repeated texts count each time; characters that
the training texts lack share the unknown one's probability; a model of no texts is an empty table, under which nothing
has a score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let
from corvane.sources.sinks import kept

START, END = "\x02", "\x03"
#: Discounts where counts of counts give none.
FALLBACK = (0.5, 1.0, 1.5)
#: A model is sent to the tasks as a trie if its grams hold at most so many bytes (36 a gram, about).
TRIE_BYTES, GRAM_BYTES = 256 << 20, 36
#: Characters whose grams are counted at once in a task.
WINDOW = 1 << 21


def framed(text: Column) -> Column:
    """The characters of a text with START and END; null for null and empty texts."""
    return F.when(F.length(text) > 0, F.concat(F.array(F.lit(START)), F.split(F.translate(text, " ", "|"), ""), F.array(F.lit(END))))


def _utf8(codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of the given sizes from all their code points."""
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    ends = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(sizes))].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode()))


def _windows(codes: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(grams, how often) of windows of texts set end to end: the gram of the given length that ends at each character but
    a text's first; shorter ones at a text's beginning."""
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(1, len(alphabet) + 1)  # 0: no character
    begins = np.zeros(len(codes), bool)
    begins[starts] = True
    per_key = 1  # characters that one key of 63 bits holds
    while per_key < order and (len(alphabet) + 1) ** (per_key + 1) < 1 << 63:
        per_key += 1
    for low in range(0, len(codes), WINDOW):
        high, before = min(len(codes), low + WINDOW), min(low, order - 1)
        own = np.append(np.zeros(order - 1 - before, np.int64), number[codes[low - before : high]].astype(np.int64))
        new = np.append(np.zeros(order - 1 - before, bool), begins[low - before : high])
        inside, ending, keys = np.ones(high - low, bool), ~begins[low:high], []
        for back in range(order):
            if back % per_key == 0:
                keys.append(np.zeros(high - low, np.int64))
            keys[-1] += np.where(inside, own[order - 1 - back : len(own) - back], 0) * (len(alphabet) + 1) ** (back % per_key)
            inside &= ~new[order - 1 - back : len(new) - back]
        keys = [k[ending] for k in keys]
        if len(keys) == 1:
            found, n = np.unique(keys[0], return_counts=True)
            found = [found]
        else:
            found, n = np.unique(np.stack(keys), axis=1, return_counts=True)
        if not len(n):
            continue
        places = []  # of each gram its last character's number, the one before it, ...
        for back in range(order):
            key, c = np.divmod(key if back % per_key else found[back // per_key], len(alphabet) + 1)
            places.append(c)
        whole = np.stack(places[::-1], 1)
        yield _utf8(alphabet[whole[whole > 0] - 1], (whole > 0).sum(1)), n


def gram_counts(texts: DataFrame, text: str, order: int) -> DataFrame:
    """(gram, n): grams of the highest order and those of texts' beginnings, counted in windows of text before they are
    shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, last = [], 0, batch.num_rows - 1
            for i, value in enumerate(batch.column(0)):
                t = value.as_py()
                if t:
                    held.append(START + t.replace(" ", "|") + END)
                    size += len(held[-1])
                if held and (size >= WINDOW or i == last):
                    codes = np.frombuffer("".join(held).encode("utf-32-le"), "<u4")
                    starts = np.cumsum([0, *map(len, held[:-1])])
                    held, size = [], 0
                    for found, n in _windows(codes, starts, order):
                        yield pa.RecordBatch.from_arrays([found, pa.array(n, pa.int64())], names=["gram", "n"])

    return texts.select(text).mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def counts(texts: DataFrame, text: str, order: int) -> list[DataFrame]:
    """(gram, n) of each order from 1 on, each written down."""
    raw = kept(gram_counts(texts, text, order), "grams")
    levels = [raw.where(F.length("gram") == order)]
    for k in range(order - 1, 0, -1):
        continued = levels[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        levels.insert(0, kept(continued.unionByName(raw.where(F.length("gram") == k)), f"grams{k}"))
    return levels


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """What is taken from counts of one, two, and three or more, from how many grams have counts of one to four."""
    n1, n2, n3, n4 = level.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()
    if not (n1 and n2 and n3 and n4):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 <= d <= i for i, d in enumerate(found, 1)) else FALLBACK


def fit(texts: DataFrame, text: str, order: int = 6) -> DataFrame:
    """(gram, logp, backoff): natural logarithms of a gram's last character's probability after the others, and of the
    weight that the gram, as a context, leaves to shorter ones (0 if it is none).  START has no logp; the unknown
    character's is under the empty gram."""
    lower = backoffs = unknown = None
    orders = []
    for k, level in enumerate(counts(texts, text, order), 1):
        one, two, three = discounts(level)
        taken = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(three)
        context = F.substring("gram", 1, k - 1)
        left = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(taken).alias("taken")).withColumn("gamma", F.col("taken") / F.col("total"))
        left = kept(left.select("context", "total", "gamma"), f"contexts{k}")
        own = level.withColumn("context", context).join(left, "context").withColumn("u", (F.col("n") - taken) / F.col("total"))
        if k == 1:
            # all known characters and the unknown one share what is left
            types = level.count() + 1
            p = own.select("gram", (F.col("u") + F.col("gamma") / types).alias("p"))
            unknown = left.select(F.lit("").alias("gram"), F.log(F.col("gamma") / types).alias("logp"))
        else:
            below = lower.select(F.col("gram").alias("context2"), F.col("p").alias("q"))
            p = own.join(below, F.substring("gram", 2, k) == F.col("context2")).select("gram", (F.col("u") + F.col("gamma") * F.col("q")).alias("p"))
            weights = left.select(F.col("context").alias("gram"), F.log("gamma").alias("backoff"))
            backoffs = weights if backoffs is None else backoffs.unionByName(weights)
        lower = kept(p, f"probabilities{k}")
        orders.append(lower.select("gram", F.log("p").alias("logp")))
    known = reduce(DataFrame.unionByName, orders)
    if backoffs is not None:
        known = known.join(backoffs, "gram", "full")
    else:
        known = known.withColumn("backoff", F.lit(0.0))
    return kept(known.unionByName(unknown, allowMissingColumns=True).select("gram", "logp", F.coalesce("backoff", F.lit(0.0)).alias("backoff")), "model")


# --------------------------------------------------------------------------- scores by joins


def score_by_join(df: DataFrame, key: str, text: str, model: DataFrame, order: int = 6) -> DataFrame:
    """(key, tokens, score): the log probability of each text, END included, under a model of any size.  Each place looks up
    the grams that end there and the weights of those that end before it; rows need a key of their own."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    chars = rows.where(F.length("_text") > 0).select("_key", framed(F.col("_text")).alias("a"))
    piece = lambda a, i, k: F.struct(i.alias("i"), k.alias("k"), F.array_join(F.slice(a, i - k + 2, k), "").alias("gram"))
    ending = lambda a, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(order), i + 1)), lambda k: piece(a, i, k))
    places = let(F.col("a"), lambda a: F.flatten(F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ending(a, i))))
    met = chars.select("_key", F.inline(places)).join(model, "gram")
    ends = met.where("logp is not null and i > 0").select("_key", "i", "k", "logp", F.lit(None).cast("double").alias("backoff"))
    before = met.where(F.col("k") < order).select("_key", (F.col("i") + 1).alias("i"), "k", F.lit(None).cast("double").alias("logp"), "backoff")
    # at most 2 * order rows a place
    longest = F.max(F.when(F.col("logp").isNotNull(), F.struct("k", "logp"))).alias("m")
    at = ends.unionByName(before).groupBy("_key", "i").agg(longest, F.collect_list(F.when(F.col("backoff").isNotNull(), F.struct("k", "backoff"))).alias("b"))
    unknown = model.where("gram = ''").select(F.col("logp").alias("unknown"))
    at = chars.select("_key", F.explode(F.sequence(F.lit(1), F.size("a") - 1)).alias("i")).join(at, ["_key", "i"], "left").crossJoin(F.broadcast(unknown))  # one row
    left = F.aggregate(F.filter("b", lambda x: x["k"] >= F.coalesce(F.col("m.k"), F.lit(0))), F.lit(0.0), lambda a, x: a + x["backoff"])
    total = at.groupBy("_key").agg(F.sum(F.coalesce("m.logp", "unknown") + F.coalesce(left, F.lit(0.0))).alias("score"))
    sized = rows.select("_key", F.when(F.length("_text") > 0, F.length("_text") + 1).cast("bigint").alias("tokens"))
    return sized.join(total, "_key", "left").withColumnRenamed("_key", key)


# --------------------------------------------------------------------------- the model as a packed trie


class Trie:
    """A model as sorted arrays: level k holds, for each gram of k characters, its parent's place times the alphabet's
    size plus its last character's number, in order, with its two logarithms."""

    def __init__(self, grams: list, logp: np.ndarray, backoff: np.ndarray):
        self.alphabet = np.unique(np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32))
        self.size = len(self.alphabet) + 1  # the last number is the unknown character's
        lengths = np.fromiter(map(len, grams), np.int64, len(grams))
        self.unknown = float(logp[lengths == 0][0]) if (lengths == 0).any() else -np.inf
        self.order = int(lengths.max(initial=0))
        self.keys, self.logp, self.backoff = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1)]
        for k in range(1, self.order + 1):
            at = np.flatnonzero(lengths == k)
            codes = self.numbers("".join(grams[i] for i in at.tolist())).reshape(-1, k)
            parent = np.zeros(len(at), np.int64)
            for j in range(k - 1):
                parent = self.step(j + 1, parent, codes[:, j])
            keys = parent * self.size + codes[:, -1]
            sort = np.argsort(keys)
            self.keys.append(keys[sort])
            self.logp.append(logp[at][sort])
            self.backoff.append(backoff[at][sort])

    @classmethod
    def load(cls, model: DataFrame, limit: int = TRIE_BYTES) -> Trie | None:
        """The trie of a model, or None if it is larger than the limit."""
        if model.count() * GRAM_BYTES > limit:
            return None
        t = model.toArrow()
        return cls(t["gram"].to_pylist(), t["logp"].to_numpy().astype(float), t["backoff"].to_numpy().astype(float))

    def numbers(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, codes)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == codes[known]
        return np.where(known, at, self.size - 1)

    def step(self, k: int, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Places at level k of the children of places at level k - 1; -1 where there is none."""
        keys, want = self.keys[k], node * self.size + code
        if not len(keys):
            return np.full(len(want), -1)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((node >= 0) & (keys[at] == want), at, -1)

    def score(self, texts: list[str]) -> np.ndarray:
        """The log probability of each text, END included; nan for empty ones."""
        out = np.full(len(texts), np.nan)
        full = [i for i, t in enumerate(texts) if t]
        if not full or not self.order:
            return out
        lengths = np.array([len(texts[i]) + 2 for i in full])
        codes = self.numbers("".join(START + texts[i].replace(" ", "|") + END for i in full))
        who, n = np.repeat(np.arange(len(full)), lengths), len(codes)
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # nodes[k][i]: the gram of k characters that ends at i
        nodes = [np.zeros(n, np.int64)]
        begun = np.zeros(n, np.int64)  # the gram of k characters that begins at i
        for k in range(1, self.order + 1):
            end = np.minimum(np.arange(n) + k - 1, n - 1)
            begun = np.where((np.arange(n) + k <= n) & (who[end] == who), self.step(k, begun, codes[end]), -1)
            ends = np.full(n, -1)
            ends[k - 1 :] = begun[: max(0, n - k + 1)]
            nodes.append(np.where(place >= k - 1, ends, -1))
        total, left, found = np.zeros(n), np.zeros(n), np.zeros(n, bool)
        for k in range(self.order, 0, -1):
            own = nodes[k]
            value = self.logp[k][own] if len(self.logp[k]) else np.full(n, np.nan)
            new = ~found & (own >= 0) & ~np.isnan(value)
            total[new] = value[new] + left[new]
            found |= new
            if k > 1 and len(self.backoff[k - 1]):
                context = np.append(-1, nodes[k - 1][:-1])
                ok = ~found & (context >= 0) & (place >= k - 1)
                left[ok] += self.backoff[k - 1][context[ok]]
        total[~found] = self.unknown + left[~found]
        out[full] = np.bincount(who[place > 0], total[place > 0], len(full))
        return out

    def after(self, context: np.ndarray) -> np.ndarray:
        """Log probabilities of every character number after a context of numbers (its last order - 1 count)."""
        out, left = np.full(self.size, np.nan), 0.0
        context = context[max(0, len(context) - self.order + 1) :]
        for start in range(len(context) + 1):
            node = np.zeros(1, np.int64)
            for j, c in enumerate(context[start:], 1):
                node = self.step(j, node, np.array([c]))
            if node[0] < 0:
                continue
            k = len(context) - start
            low, high = np.searchsorted(self.keys[k + 1], [node[0] * self.size, (node[0] + 1) * self.size])
            code = self.keys[k + 1][low:high] - node[0] * self.size
            value = self.logp[k + 1][low:high]
            new = np.isnan(out[code]) & ~np.isnan(value)
            out[code[new]] = value[new] + left
            if k:
                left += self.backoff[k][node[0]]
        out[np.isnan(out)] = self.unknown + left
        return out


def shared(df: DataFrame, trie: Trie) -> Callable[[], Trie]:
    """The trie, of checked size, once on each executor."""
    sent = df.sparkSession.sparkContext.broadcast(trie)
    return lambda: sent.value


def score(df: DataFrame, key: str, text: str, model: DataFrame, order: int = 6, limit: int = TRIE_BYTES) -> DataFrame:
    """(key, tokens, score) of each text: under a trie sent to the tasks if the model is small enough, else by joins."""
    trie = Trie.load(model, limit)
    if trie is None:
        return score_by_join(df, key, text, model, order)
    if not trie.order:
        return df.select(key, F.lit(None).cast("bigint").alias("tokens"), F.lit(None).cast("double").alias("score"))
    there = shared(df, trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = there()
        for b in batches:
            texts = b.column(1).to_pylist()
            values = [v if t else None for t, v in zip(texts, known.score([t or "" for t in texts]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) + 1 if t else None for t in texts], pa.int64()), pa.array(values, pa.float64())], names=[key, "tokens", "score"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, tokens bigint, score double")
