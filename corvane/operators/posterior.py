"""Posterior-matrix operators: built-in array expressions, and kernels where a dynamic program is needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import let

NEG = -1e30


def log_softmax(v: Column) -> Column:
    """Log probabilities; the maximum and the sum are bound once, so a frame costs its symbols once each."""
    return let(v.cast("array<double>"), lambda x: let(F.array_max(x), lambda top: let(F.log(F.aggregate(x, F.lit(0.0), lambda a, y: a + F.exp(y - top))), lambda total: F.transform(x, lambda y: y - top - total))))


def select_columns(v: Column, blank: int, first: int, n: int) -> Column:
    """The blank and a range of columns, made a distribution again."""
    return log_softmax(F.concat(F.slice(v, blank + 1, 1), F.slice(v, first + 1, n)))


def penalise_blank(v: Column, beta: Column | float) -> Column:
    return F.transform(v, lambda x, i: F.when(i == 0, x - beta).otherwise(x))


def argmax(v: Column) -> Column:
    """The first largest place, from 0."""
    return F.array_position(v, F.array_max(v)) - 1


def greedy(frames: DataFrame, unit: str, t: str, logp: str, labels: list[str] | None = None) -> DataFrame:
    """Free decode: best symbol of each frame, runs collapsed, blanks (0) dropped.  Text if labels are given."""
    from corvane.operators.sequence import collapse_runs

    best = frames.select(unit, t, argmax(F.col(logp)).alias("k"), F.array_max(logp).alias("lp"))
    kept = collapse_runs(best, unit, t, "k", blank=F.col("k") == 0)
    ordered = F.sort_array(F.collect_list(F.struct(t, "k", "lp")))  # the frames of one utterance
    out = kept.groupBy(unit).agg(F.transform(ordered, lambda x: x["k"]).alias("ids"), F.exp(F.avg("lp")).alias("conf"))
    if labels is None:
        return out
    names = F.array(*(F.lit(x) for x in labels))
    return out.withColumn("text", F.trim(F.replace(F.array_join(F.transform("ids", lambda k: F.element_at(names, k.cast("int"))), ""), F.lit("▁"), F.lit(" "))))


def blank_sweep(frames: DataFrame, unit: str, t: str, logp: str, betas: list[float]) -> DataFrame:
    """Greedy decodes for each blank penalty."""
    swept = frames.withColumn("beta", F.explode(F.array(*(F.lit(float(b)) for b in betas))))
    swept = swept.withColumn("_u", F.struct(unit, "beta")).withColumn("_v", penalise_blank(F.col(logp), F.col("beta")))
    return greedy(swept, "_u", t, "_v").select(f"_u.{unit}", "_u.beta", "ids", "conf")


def entropy(v: Column) -> Column:
    """Entropy of a log distribution over the entropy of the uniform one."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a - F.exp(x) * x) / F.log(F.size(v))


def frame_entropy(frames: DataFrame, unit: str, logp: str) -> DataFrame:
    """Mean normalised entropy over frames whose best symbol is not blank."""
    return frames.where(argmax(F.col(logp)) != 0).groupBy(unit).agg(F.avg(entropy(F.col(logp))).alias("entropy"), F.count("*").alias("frames"))


def word_confidence(emitted: DataFrame, unit: str, t: str, starts: Column, lp: str, worst: bool = False) -> DataFrame:
    """Words as islands of emitted tokens: span and the geometric mean of their probabilities; with `worst` also the
    smallest log probability."""
    from corvane.operators.sequence import islands, spans

    more = [F.min(lp).alias("worst")] if worst else []
    return spans(islands(emitted, unit, t, starts), unit, t, F.exp(F.avg(lp)).alias("conf"), *more, F.count("*").alias("tokens"))


def spread_times(frames: DataFrame, unit: str, duration: str) -> DataFrame:
    return frames.groupBy(unit, duration).agg((F.col(duration) / F.count("*")).alias("frame_seconds"))


def _extended(ids: list[int]) -> np.ndarray:
    out = np.zeros(2 * len(ids) + 1, np.int64)
    out[1::2] = ids
    return out


def forward_score(logp: np.ndarray, ids: list[int], blank: int = 0) -> float:
    """Log probability of a label sequence under all its alignments; -1e30 for none."""
    if len(ids) == 0 or len(logp) == 0:
        return NEG
    ext = _extended(list(ids))
    ext[::2] = blank
    skip = np.zeros(len(ext), bool)
    skip[2:] = (ext[2:] != blank) & (ext[2:] != ext[:-2])
    a = np.full(len(ext), NEG)
    a[:2] = logp[0, ext[:2]]
    for row in logp[1:]:
        one, two = np.full(len(ext), NEG), np.full(len(ext), NEG)
        one[1:], two[2:] = a[:-1], a[:-2]
        a = np.logaddexp(np.logaddexp(a, one), np.where(skip, two, NEG)) + row[ext]
    return float(np.logaddexp(a[-1], a[-2]))


def best_path(logp: np.ndarray, ids: list[int], blank: int = 0) -> np.ndarray | None:
    """The number of the token that each frame holds on the best alignment, -1 on blank; None if there is none.  A frame
    is in the gap before a token, in a token, or in the gap after the last.  Of equal scores staying wins, then coming
    from the neighbour, then passing over a gap; a path that can end in the last gap does."""
    tokens = np.asarray(ids, np.int64)
    if not len(tokens) or not len(logp):
        return None
    none = np.full(1, -np.inf)
    gap, token = np.full(len(tokens) + 1, -np.inf), np.full(len(tokens), -np.inf)
    gap[0], token[0] = logp[0, blank], logp[0, tokens[0]]
    closed = np.append(True, tokens[1:] == tokens[:-1])  # a repeated token needs a gap before it
    # choices are held for a block of frames at once, and scores at the start of each; 16 bytes against 2 for a token
    block = math.isqrt(8 * len(logp)) + 1
    heads = []
    for t in range(1, len(logp)):
        if (t - 1) % block == 0:
            heads.append((gap, token))
        ended = np.append(none, token)
        passed = np.where(closed, -np.inf, ended[:-1])
        token = np.maximum(np.maximum(token, gap[:-1]), passed) + logp[t, tokens]
        gap = np.maximum(gap, ended) + logp[t, blank]

    def choices(start: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the frames from start on, whether a gap is entered there, and what a token comes from."""
        gap, token = heads[(start - 1) // block]
        frames = range(start, min(start + block, len(logp)))
        entered, source = np.zeros((len(frames), len(tokens) + 1), bool), np.zeros((len(frames), len(tokens)), np.int8)
        for i, t in enumerate(frames):
            ended = np.append(none, token)
            passed = np.where(closed, -np.inf, ended[:-1])
            entered[i] = ended > gap
            source[i] = np.where(token >= np.maximum(gap[:-1], passed), 0, np.where(gap[:-1] >= passed, 1, 2))
            token = np.maximum(np.maximum(token, gap[:-1]), passed) + logp[t, tokens]
            gap = np.maximum(gap, ended) + logp[t, blank]
        return entered, source

    k, resting = len(tokens) - 1, gap[-1] >= token[-1]
    if np.isneginf(max(gap[-1], token[-1])):
        return None
    owner = np.full(len(logp), -1, np.int64)
    place = len(tokens) if resting else k
    for start in range((len(heads) - 1) * block + 1, 0, -block):
        entered, source = choices(start)
        for t in range(start + len(source) - 1, start - 1, -1):
            if resting:
                if entered[t - start, place]:
                    resting, place = False, place - 1
                continue
            owner[t] = place
            came = source[t - start, place]
            resting, place = came == 1, place - (came == 2)
    if not resting:
        owner[0] = place
    return owner


def token_scores(logp: np.ndarray, ids: list[int], classes: dict | None = None) -> list[dict] | None:
    """Of each token of an alignment: span, mean log probability (raw), mean of it less the frame's best (norm), and the
    top competitor at its worst frame.  With `classes` a token scores the best of its class, and blank does not
    compete."""
    path = best_path(logp, ids)
    if path is None:
        return None
    out = []
    held = np.flatnonzero(path >= 0)
    ends = np.searchsorted(path[held], np.arange(len(ids) + 1))  # tokens come in order
    for k, token in enumerate(ids):
        at = held[ends[k] : ends[k + 1]]
        own = logp[np.ix_(at, classes.get(token, [token]) if classes else [token])].max(1)
        best = (logp[at, 1:] if classes else logp[at]).max(1)
        rival = logp[at].copy()
        rival[:, [0, *(classes.get(token, [token]) if classes else [token])]] = NEG
        worst = int((own - best).argmin())
        counts = np.bincount(rival.argmax(1), minlength=1)
        out.append({
            "k": k, "token": int(token), "start": int(at[0]), "end": int(at[-1]) + 1, "raw": float(own.mean()), "norm": float((own - best).mean()), "confuser": int(counts.argmax()),
            "worst_frame": int(at[worst]), "worst_own": float(own[worst]), "worst_rival": int(rival[worst].argmax()), "worst_rival_lp": float(rival[worst].max()),
        })
    return out


SCORES = "k int, token int, start int, end int, raw double, norm double, confuser int, worst_frame int, worst_own double, worst_rival int, worst_rival_lp double"


def align_tokens(frames: DataFrame, targets: DataFrame, unit: str, t: str = "t", logp: str = "logp", ids: str = "ids", classes: dict | None = None) -> DataFrame:
    """Forced alignment of each utterance's target ids: one row for each token; infeasible ones give none.  One
    utterance's frames meet in a task."""
    kind = frames.schema[unit].dataType.simpleString()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [unit, *(c.split()[0] for c in SCORES.split(", "))]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        matrix = np.stack(left.sort_values(t)[logp].to_list()).astype(float)
        rows = token_scores(matrix, [int(i) for i in right[ids].iloc[0]], classes) or []
        return pd.DataFrame([{unit: key[0], **r} for r in rows], columns=columns)

    return frames.groupBy(unit).cogroup(targets.groupBy(unit)).applyInPandas(run, f"{unit} {kind}, {SCORES}")


def segments(aligned: DataFrame, unit: str, part: Column, frame_seconds: float, least: float = -2.0, shortest: float = 1.0, longest: float = 20.0) -> DataFrame:
    """Parts (verses) of aligned utterances: span in seconds and the mean log probability of their tokens, where it
    reaches a bound and the length is within bounds."""
    g = aligned.groupBy(unit, part.alias("part")).agg(F.min("start").alias("a"), F.max("end").alias("b"), F.avg("raw").alias("score"))
    g = g.select(unit, "part", (F.col("a") * frame_seconds).alias("start_s"), (F.col("b") * frame_seconds).alias("end_s"), "score")
    return g.where((F.col("score") >= least) & (F.col("end_s") - F.col("start_s")).between(shortest, longest))


def confusion_map(aligned: DataFrame) -> DataFrame:
    """Of each token its most frequent confuser, the smaller of equals, and how often it is that."""
    counts = aligned.groupBy("token", "confuser").agg(F.count("*").alias("n"))
    return counts.groupBy("token").agg(F.max_by("confuser", F.struct("n", (-F.col("confuser")).alias("o"))).alias("confuser"), F.max("n").alias("n"), F.sum("n").alias("of"))


def sequence_scores(frames: DataFrame, candidates: DataFrame, unit: str, t: str = "t", logp: str = "logp") -> DataFrame:
    """Forward score of each candidate id sequence (unit, cand, ids) on its utterance."""
    kind = frames.schema[unit].dataType.simpleString()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[unit, "cand", "score"])
        matrix = np.stack(left.sort_values(t)[logp].to_list()).astype(float)
        return pd.DataFrame({unit: key[0], "cand": right["cand"], "score": [forward_score(matrix, [int(i) for i in x]) for x in right["ids"]]})

    return frames.groupBy(unit).cogroup(candidates.groupBy(unit)).applyInPandas(run, f"{unit} {kind}, cand string, score double")


def corrupt(tokens: DataFrame, key: list[str], token: str, replacement: str, share: float = 0.3, seed: int = 7) -> DataFrame:
    """Swaps a share of tokens, drawn by a digest of the seed and the key, for their replacement; adds corrupted."""
    named = F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in key)))
    draw = F.conv(F.substring(named, 1, 8), 16, 10).cast("bigint") % 10_000 < int(share * 10_000)
    return tokens.withColumn("corrupted", draw & (F.col(token) != F.col(replacement))).withColumn(token, F.when(F.col("corrupted"), F.col(replacement)).otherwise(F.col(token)))


def rescore(nbest: DataFrame, key: str, text: str, am: str, lm: str, length: str, alpha: float, beta: float) -> DataFrame:
    """The best of an n-best list under am + alpha * lm + beta * length."""
    total = F.col(am) + alpha * F.col(lm) + beta * F.col(length)
    return nbest.groupBy(key).agg(F.max_by(text, F.struct(total, text)).alias(text), F.max(total).alias("total"))


def rescore_sweep(nbest: DataFrame, key: str, text: str, am: str, lm: str, length: str, alphas: list[float], beta: float) -> DataFrame:
    """The best of an n-best list for each language model weight."""
    swept = nbest.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas))))
    total = F.col(am) + F.col("alpha") * F.col(lm) + beta * F.col(length)
    return swept.groupBy("alpha", key).agg(F.max_by(text, F.struct(total, text)).alias(text), F.max(total).alias("total"))


def best_setting(results: DataFrame, setting: list[str], rate: str, *by: str) -> DataFrame:
    """The setting with the lowest rate; ties go to the smaller setting."""
    return results.groupBy(*by).agg(F.min_by(F.struct(*setting), F.struct(rate, *setting)).alias("s"), F.min(rate).alias(rate)).select(*by, "s.*", rate)


def frame_rows(vectors: DataFrame, unit: str, key: str, vector: str) -> DataFrame:
    """Vectors as frames of utterances: t counts within the unit in key order."""
    return vectors.select(unit, (F.row_number().over(Window.partitionBy(unit).orderBy(key)) - 1).alias("t"), log_softmax(F.col(vector)).alias("logp"))
