"""CTC segmentation: where utterances of known text begin and end in a long recording, and how well they fit.

The tokens of all utterances, a blank between two of them, are laid over the frames: a frame enters the next token or stays
in the last one (by its own symbol or the blank, whichever is likelier); frames before the first token and after the last cost
nothing.  The table is computed column by column (a token each), the best time of entry for each frame being a running
maximum, within a window of frames that follows the best end of the column before.  Columns are kept at checkpoints alone
and computed again, block by block, on the way back.  The window doubles until the path stays inside it and the next window
gives the same path: a window follows what it has seen, so it should be longer than any stretch of foreign frames.  With
`window` None the whole table is computed, which is always the best path.

Defined cases: utterances without tokens are left out; recordings without frames, or with fewer frames than tokens, give no
rows; frames without a vector are skipped; a null recording is a recording.  One recording is in a task at a time: its
frames, and about window * sqrt(tokens) numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of the first window; frames of a scoring window; seconds that a segment may reach beyond its first and last token.
WINDOW, SPAN, MARGIN = 8000, 30, 0.5
#: Scores that differ by less are equal (a blank between two tokens can be entered early or late at the same score).
EQUAL = 1e-9


class Table:
    """Columns of the trellis within windows of the given width."""

    def __init__(self, logp: np.ndarray, tokens: np.ndarray, blank: int, width: int):
        self.logp, self.tokens, self.blank, self.n, self.width = logp, tokens, blank, len(logp), min(width, len(logp) + 1)

    def column(self, c: int, offset: int, before: np.ndarray | None, before_offset: int) -> tuple[np.ndarray, np.ndarray]:
        """Of token c: the best score after `offset` .. frames, and what entering after a number of frames is worth beside
        the frames that follow."""
        taus = np.arange(offset, min(offset + self.width, self.n + 1))
        own, silent = self.logp[:, self.tokens[c]], self.logp[:, self.blank]
        frames = np.maximum(taus - 1, 0)
        stays = np.maximum(own[frames], silent[frames])
        total = np.cumsum(stays)  # of staying in every frame up to a place
        if before is None:
            base = np.zeros(len(taus))
        else:
            at = taus - 1 - before_offset
            base = np.where((at >= 0) & (at < len(before)), before[np.clip(at, 0, len(before) - 1)], -np.inf)
        enter = np.where(taus > 0, base + own[frames], -np.inf) - total
        return total + np.maximum.accumulate(enter), enter

    def path(self) -> tuple[np.ndarray, int, bool] | None:
        """The frame that enters each token, the number of frames up to the end, and whether the path is off the windows'
        edges; None if no path ends."""
        m = len(self.tokens)
        every = max(1, int(m**0.5))
        offsets, marks = np.zeros(m, np.int64), {}
        best, offset = None, 0
        for c in range(m):
            if c % every == 0:
                marks[c] = (best, offsets[c - 1] if c else 0)
            if c:
                centre = int(np.argmax(best)) + offset
                offset = max(offset, min(centre - self.width // 2, self.n + 1 - self.width))
            offsets[c] = offset
            best, _ = self.column(c, offset, marks[c][0] if c in marks else best, offsets[c - 1] if c else 0)
        if not np.isfinite(best.max()):
            return None
        end = int(np.flatnonzero(best >= best.max() - EQUAL)[0]) + offset
        entries, tau, inside = np.zeros(m, np.int64), end, self._inside(end, offset)
        for block in range((m - 1) // every * every, -1, -every):
            best, back = marks[block][0], []
            for c in range(block, min(block + every, m)):
                best, enter = self.column(c, offsets[c], best, offsets[c - 1] if c else 0)
                back.append(enter)
            for c in range(min(block + every, m) - 1, block - 1, -1):
                reach = back[c - block][: tau - offsets[c] + 1]
                tau = int(offsets[c]) + int(np.flatnonzero(reach >= reach.max() - EQUAL)[-1])  # of equal ones the latest
                inside &= self._inside(tau, offsets[c])
                tau -= 1
                entries[c] = tau
        return entries, end, inside

    def _inside(self, tau: int, offset: int) -> bool:
        return (tau > offset + 1 or offset == 0) and (tau < offset + self.width - 1 or offset + self.width > self.n)


def best_entries(logp: np.ndarray, tokens: list[int], blank: int = 0, window: int | None = WINDOW) -> tuple[np.ndarray, int] | None:
    """The frame that enters each token, and the number of frames up to the end; None if there are too few frames."""
    ids, last = np.asarray(tokens, np.int64), None
    if len(ids) > len(logp) or not len(logp):
        return None
    window = window or len(logp) + 1
    while True:
        found = Table(logp, ids, blank, window).path()
        whole = window > len(logp)
        if whole:
            return None if found is None else found[:2]
        if found is None or not found[2]:
            last = None
        elif last is not None and last[1] == found[1] and (last[0] == found[0]).all():
            return found[:2]
        else:
            last = found[:2]
        window *= 2


def worst_mean(p: np.ndarray, span: int = SPAN) -> float:
    """The smallest mean of `span` values in a row; of all if there are fewer."""
    if len(p) <= span:
        return float(p.mean())
    sums = np.cumsum(np.append(0.0, p))
    return float((sums[span:] - sums[:-span]).min() / span)


def segments(logp: np.ndarray, utterances: list[list[int]], frame_seconds: float, blank: int = 0, window: int | None = WINDOW, span: int = SPAN, margin: float = MARGIN) -> list[tuple] | None:
    """(utterance, start, end in seconds, score, first frame, end frame) of each utterance with tokens; None if they do
    not fit into the frames."""
    tokens, bounds = [], []
    for u, ids in enumerate(utterances):
        if len(ids):
            tokens += [blank] * bool(tokens)
            bounds.append((u, len(tokens), len(tokens) + len(ids) - 1))
            tokens += ids
    if not tokens:
        return []
    found = best_entries(logp, tokens, blank, window)
    if found is None:
        return None
    entries, end = found
    held = np.repeat(np.arange(len(tokens)), np.diff(np.append(entries, end)))  # the token of each frame from the first on
    rows = logp[entries[0] : end]
    own = rows[np.arange(len(rows)), np.asarray(tokens)[held]]
    p = np.maximum(own, rows[:, blank])
    p[entries - entries[0]] = own[entries - entries[0]]
    out = []
    for u, a, b in bounds:
        first, last = int(entries[a]), int(entries[b])
        before, after = int(entries[a - 1]) if a else first, int(entries[b + 1]) if b + 1 < len(tokens) else end
        start, stop = max(first * frame_seconds - margin, (first + before) / 2 * frame_seconds), min(last * frame_seconds + margin, (last + after) / 2 * frame_seconds)
        out.append((u, start, stop, worst_mean(p[first - entries[0] : after - entries[0]], span), first, after))
    return out


def ctc_segments(frames: DataFrame, texts: DataFrame, unit: str, order: str, ids: str, frame_seconds: float, t: str = "t", logp: str = "logp", blank: int = 0, window: int | None = WINDOW, span: int = SPAN, margin: float = MARGIN) -> DataFrame:
    """(unit, order, start_s, end_s, score, first_frame, end_frame): one row for each utterance (`ids`, in `order`) of each
    recording."""
    kinds = [frames.schema[unit].dataType.simpleString(), texts.schema[order].dataType.simpleString()]
    columns = [unit, order, "start_s", "end_s", "score", "first_frame", "end_frame"]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left[left[logp].notna()].sort_values(t), right[right[ids].notna()].sort_values(order)
        found = None
        if len(left) and len(right):
            found = segments(np.stack(left[logp].to_list()).astype(float), [[int(i) for i in x] for x in right[ids]], frame_seconds, blank, window, span, margin)
        return pd.DataFrame([(key[0], right[order].iloc[u], *rest) for u, *rest in found or []], columns=columns)

    schema = f"`{unit}` {kinds[0]}, `{order}` {kinds[1]}, start_s double, end_s double, score double, first_frame bigint, end_frame bigint"
    return frames.select(unit, t, logp).groupBy(unit).cogroup(texts.select(unit, order, ids).groupBy(unit)).applyInPandas(run, schema)


def fitting(found: DataFrame, least: float = -2.0, shortest: float = 1.0, longest: float = 20.0) -> DataFrame:
    """The segments that fit well enough and are of a usable length."""
    return found.where((F.col("score") >= least) & (F.col("end_s") - F.col("start_s")).between(shortest, longest))
