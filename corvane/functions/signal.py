"""Signals as arrays of samples: mixdown, resampling by truncated index, silence around."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import let

RATE, SILENCE = 16_000, 0.3


def mixdown(samples: Column, channels: Column | int) -> Column:
    """The mean of the channels of interleaved samples; an incomplete last frame is dropped.  One channel stays as it is."""
    channels = F.lit(channels) if isinstance(channels, int) else channels
    frames = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda s: F.transform(_upto(frames), lambda i: F.aggregate(F.slice(s, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels)
    return F.when(channels == 1, samples.cast("array<double>")).otherwise(let(samples.cast("array<double>"), mean))


def resample(samples: Column, rate: Column | int, target: int = RATE) -> Column:
    """Sample i of the result is sample int(i * rate / target) of the signal, clipped to its last; there are
    int(length * target / rate) of them.  An equal rate stays as it is."""
    rate = F.lit(rate) if isinstance(rate, int) else rate

    def taken(s: Column) -> Column:
        n = (F.size(s) * F.lit(float(target)) / rate).cast("int")
        return F.transform(_upto(n), lambda i: F.get(s, F.least((i * rate / F.lit(float(target))).cast("int"), F.size(s) - 1)))

    return F.when(rate == target, samples).otherwise(let(samples, taken))


def padded(samples: Column, seconds: float = SILENCE, rate: int = RATE) -> Column:
    """Silence before and after."""
    silence = F.array_repeat(F.lit(0.0), int(seconds * rate))
    return F.concat(silence, samples, silence)


def prepared(samples: Column, rate: Column | int, channels: Column | int = 1, target: int = RATE, seconds: float = SILENCE) -> Column:
    """A signal as recognisers take it: one channel at the target rate with silence around."""
    return padded(resample(mixdown(samples, channels), rate, target), seconds, target)


def _upto(n: Column) -> Column:
    """0 .. n - 1; null for null, so a null signal stays null."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n.isNotNull(), F.array().cast("array<int>"))
