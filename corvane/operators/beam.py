"""Prefix beam search over CTC posteriors, with a character language model and hotwords.

A beam holds prefixes, each with the log mass of its alignments that end in blank and of those that do not.  A frame either
keeps a prefix (blank, or its last symbol again) or extends it; an extension that is in the beam already gets the mass of
both.  Prefixes are ranked by mass + alpha * language model + beta * characters + hotwords; with `width` None none is
pruned, and the result is the sum over all alignments.

A hotword adds `weight` when it stands as a whole word.  While a word is only begun, it adds its share of the shortest
hotword that begins so, and gives it back when it goes another way or ends early.

Defined cases: frames without a vector are skipped; an utterance without frames gives no rows; ties go to the smaller text;
a null unit is an utterance.  One utterance is in a task at a time, with at most `width` prefixes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corvane.operators import charlm

NEG = -np.inf
#: Prefixes that a decoder keeps for the next utterances, about.
HELD = 50_000
#: Hotwords are sent to the tasks, at most so many.
MOST_HOTWORDS = 1_000_000


class Hotwords:
    """A trie of words: of each node its children, the length of the shortest word below it, and whether a word ends."""

    def __init__(self, words: Iterable[str], weight: float):
        self.weight, self.kids, self.shortest, self.ends = weight, [{}], [0], [False]
        for w in sorted({w for w in words if w}, key=lambda w: (len(w), w)):
            node = 0
            for c in w:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.shortest.append(len(w))  # words come shortest first
                    self.ends.append(False)
                node = self.kids[node][c]
            self.ends[node] = True

    def begun(self, node: int | None, depth: int) -> float:
        """What a word of `depth` characters, begun but not ended, has so far."""
        return self.weight * depth / self.shortest[node] if node else 0.0

    def ended(self, node: int | None) -> float:
        return self.weight if node and self.ends[node] else 0.0


class Prefix:
    """A node of the prefix tree, with what does not depend on frames: its text's scores, and how each symbol changes them."""

    __slots__ = ("parent", "symbol", "kids", "context", "lm", "size", "hot", "node", "depth", "gain", "after", "extra")

    def __init__(self, parent: Prefix | None, symbol: int):
        self.parent, self.symbol, self.kids = parent, symbol, {}
        self.lm, self.size, self.hot, self.node, self.depth, self.gain, self.after, self.extra = 0.0, 0, 0.0, 0, 0, None, None, 0.0


class Beam:
    """Prefixes in order, with what does not depend on frames: their scores, and which of them is another's extension."""

    def __init__(self, prefixes: list[Prefix]):
        self.prefixes, self.next, self.texts = prefixes, {}, None
        self.last = np.array([p.symbol for p in prefixes])
        self.again = np.flatnonzero(self.last >= 0)
        self.extra, self.gains = np.array([p.extra for p in prefixes]), np.stack([p.gain for p in prefixes])
        place = {id(p): i for i, p in enumerate(prefixes)}
        met = [(i, place[id(p.parent)], p.symbol) for i, p in enumerate(prefixes) if id(p.parent) in place and p.parent.kids.get(p.symbol) is p]
        self.own, self.parent, self.symbol = np.array(met, np.int64).reshape(-1, 3).T


class Decoder:
    """Beam search for one alphabet.  labels: the text of each symbol; the blank's does not matter.  Prefixes are kept from
    one utterance to the next, at most about HELD; if none is pruned, so are the beams."""

    def __init__(self, labels: list[str], blank: int = 0, width: int | None = 100, lm: charlm.Trie | None = None, alpha: float = 0.0, beta: float = 0.0, hot: Hotwords | None = None, space: str = " "):
        self.labels, self.blank, self.width, self.lm, self.alpha, self.beta, self.hot, self.space = labels, blank, width, lm, alpha, beta, hot, space
        self.counted = np.array([beta * (i != blank and x != space) for i, x in enumerate(labels)])
        if lm:
            self.codes = lm.numbers("".join("|" if x == space or i == blank else x for i, x in enumerate(labels)))
            self.first, self.last = lm.numbers(charlm.START), lm.numbers(charlm.END)[0]
        self._forget()

    def _forget(self) -> None:
        self.held, self.known = 0, {}
        self.start = Beam([self.root()])

    def _after(self, context: tuple) -> np.ndarray:
        if context not in self.known:
            self.known[context] = self.lm.after(np.array(context, np.int64))
        return self.known[context]

    def root(self) -> Prefix:
        p = Prefix(None, -1)
        p.context = (int(self.first[0]),) if self.lm else ()
        return self._ready(p)

    def _ready(self, p: Prefix) -> Prefix:
        """Sets what each symbol would add to the score of the prefix."""
        gain = self.counted.copy()
        if self.lm:
            p.after = self._after(p.context)
            gain += self.alpha * p.after[self.codes]
        if self.hot:
            now = self.hot.begun(p.node, p.depth)
            gain -= now
            kids = self.hot.kids[p.node] if p.node is not None else {}
            for v, x in enumerate(self.labels):
                if x == self.space:
                    gain[v] += self.hot.ended(p.node)
                elif x in kids:
                    gain[v] += self.hot.begun(kids[x], p.depth + 1)
        p.gain, p.extra = gain, self.score(p)
        self.held += 1
        return p

    def extend(self, p: Prefix, v: int) -> Prefix:
        q = Prefix(p, v)
        q.context = p.context
        q.size = p.size + (self.labels[v] != self.space)
        if self.lm:
            q.lm = p.lm + float(p.after[self.codes[v]])
            q.context = (*p.context, int(self.codes[v]))[-max(1, self.lm.order - 1) :]
        if self.hot:
            q.hot, q.node, q.depth = p.hot, None, p.depth + 1
            if self.labels[v] == self.space:
                q.hot, q.node, q.depth = p.hot + self.hot.ended(p.node), 0, 0
            elif p.node is not None:
                q.node = self.hot.kids[p.node].get(self.labels[v])
        p.kids[v] = q
        return self._ready(q)

    def score(self, p: Prefix) -> float:
        hot = p.hot + self.hot.begun(p.node, p.depth) if self.hot else 0.0
        return self.alpha * p.lm + self.beta * p.size + hot

    def text(self, p: Prefix) -> str:
        out = []
        while p.parent is not None:
            out.append(self.labels[p.symbol])
            p = p.parent
        return "".join(reversed(out))

    def decode(self, frames: np.ndarray, top: int | None = None) -> list[tuple]:
        """(text, acoustic, lm, hot, total) of the best prefixes; the language model's END and open words settled."""
        if self.held > HELD:
            self._forget()
        beam, ends, runs = self.start, np.zeros(1), np.full(1, NEG)
        for logp in frames:
            n, total, last, again = len(beam.prefixes), np.logaddexp(ends, runs), beam.last, beam.again
            stay_end = total + logp[self.blank]
            stay_run = np.where(last >= 0, runs + logp[last], NEG)
            grown = total[:, None] + logp[None, :]
            grown[again, last[again]] = ends[again] + logp[last[again]]  # a repeated symbol needs a blank between
            grown[:, self.blank] = NEG
            own, at = beam.own, (beam.parent, beam.symbol)
            stay_run[own] = np.logaddexp(stay_run[own], grown[at])
            grown[at] = NEG
            scores = np.concatenate([np.logaddexp(stay_end, stay_run) + beam.extra, (grown + beam.extra[:, None] + beam.gains).ravel()])
            scores[np.isnan(scores)] = NEG
            able = np.flatnonzero(scores > NEG)
            if not len(able):
                return []
            order = able if self.width is None else able[np.argsort(-scores[able], kind="stable")][: self.width]
            beam = self._moved(beam, order)
            ends = np.concatenate([stay_end, np.full(grown.size, NEG)])[order]
            runs = np.concatenate([stay_run, grown.ravel()])[order]
        mass = np.logaddexp(ends, runs)
        if beam.texts is None:
            prefixes = beam.prefixes
            beam.texts = [self.text(p) for p in prefixes]
            beam.lm = np.array([p.lm + float(p.after[self.last]) if self.lm else 0.0 for p in prefixes])
            beam.hot = np.array([p.hot + self.hot.ended(p.node) if self.hot else 0.0 for p in prefixes])
            beam.size = np.array([p.size for p in prefixes])
        totals = mass + self.alpha * beam.lm + self.beta * beam.size + beam.hot
        best = np.arange(len(totals))
        if top is not None and 0 < top < len(totals) and not np.isnan(totals).any():
            best = np.flatnonzero(totals >= -np.partition(-totals, top - 1)[top - 1])  # and those that equal the last
        out = [(beam.texts[i], float(mass[i]), float(beam.lm[i]), float(beam.hot[i]), float(totals[i])) for i in best.tolist()]
        out.sort(key=lambda o: (-o[4], o[0]))
        return out[:top]

    def _moved(self, beam: Beam, order: np.ndarray) -> Beam:
        """The beam of the given candidates: its prefixes, then each one's extensions."""
        name = order.tobytes() if self.width is None else None
        if name in beam.next:
            return beam.next[name]
        n, kept = len(beam.prefixes), []
        for c in order.tolist():
            i, v = divmod(c - n, len(self.labels))
            kept.append(beam.prefixes[c] if c < n else beam.prefixes[i].kids.get(v) or self.extend(beam.prefixes[i], v))
        out = Beam(kept)
        if name is not None:
            beam.next[name] = out
            self.held += len(kept)
        return out


def decode(frames: DataFrame, unit: str, t: str, logp: str, labels: list[str], blank: int = 0, width: int | None = 100, top: int | None = 10, model: DataFrame | None = None, alpha: float = 0.0, beta: float = 0.0, hotwords: DataFrame | None = None, weight: float = 10.0) -> DataFrame:
    """(unit, rank, text, acoustic, lm, hot, total): the best texts of each utterance.  `model`: a character language model,
    small enough to be sent; `hotwords`: a table with a column word."""
    there = words = None
    if model is not None:
        trie = charlm.Trie.load(model)
        if trie is None:
            raise ValueError(f"the language model holds more than {charlm.TRIE_BYTES} bytes: prune it, or rescore the best texts with charlm.score_by_join")
        there = charlm.shared(frames, trie)
    if hotwords is not None:
        found = hotwords.select("word").distinct().limit(MOST_HOTWORDS + 1).toArrow()["word"].to_pylist()
        if len(found) > MOST_HOTWORDS:
            raise ValueError(f"more than {MOST_HOTWORDS} hotwords")
        words = frames.sparkSession.sparkContext.broadcast(found)
    kind = frames.schema[unit].dataType.simpleString()
    schema = f"`{unit}` {kind}, rank bigint, text string, acoustic double, lm double, hot double, total double"
    made = to_arrow_schema(StructType.fromDDL(schema))
    own: dict = {}  # a task's decoder

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.is_valid(rows[logp])).sort_by(t)
        if not rows.num_rows:
            return made.empty_table()
        if not own:
            hot = Hotwords(words.value, weight) if words is not None else None
            own["decoder"] = Decoder(labels, blank, width, there() if there else None, alpha, beta, hot)
        best = own["decoder"].decode(np.array(rows[logp].to_pylist(), float), top)
        values = ([key[0].as_py()] * len(best), range(1, len(best) + 1), *(zip(*best) if best else [()] * 5))
        return pa.table([pa.array(list(v), f.type) for v, f in zip(values, made, strict=True)], schema=made)

    return frames.select(unit, t, logp).groupBy(unit).applyInArrow(run, schema)


def rescored(nbest: DataFrame, unit: str, text: str, acoustic: str, model: DataFrame, alphas: list[float], beta: float = 0.0, order: int = 6) -> DataFrame:
    """(alpha, unit, text, total): for each weight of a language model of any size, the best text of an n-best list under
    acoustic + alpha * lm + beta * characters.  Distinct texts are scored once."""
    from pyspark.sql import functions as F

    from corvane.operators.posterior import rescore_sweep

    distinct = nbest.select(F.col(text).alias("_text")).distinct().withColumn("_same", F.col("_text"))
    scored = charlm.score(distinct, "_same", "_text", model, order).select("_same", F.col("score").alias("_lm"))
    bare = F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))
    met = nbest.join(scored, F.col(text) == F.col("_same"), "left").withColumn("_lm", F.coalesce("_lm", F.lit(-1e9))).withColumn("_n", bare)
    return rescore_sweep(met, unit, text, acoustic, "_lm", "_n", alphas, beta)
