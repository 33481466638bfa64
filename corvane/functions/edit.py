"""Edit distances: bounded ones as built-in expressions, others by the bit-parallel kernel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.align import list_distance
from corvane.functions.text import words

#: What an empty reference does to a row's rate: count as 1, add its insertions to the sums alone, or skip the row.
EMPTY_REF = ("one", "accumulate", "skip")


def char_edits(a: Column, b: Column) -> Column:
    """By the bit-parallel kernel, which takes long texts several times faster than the built-in table of distances."""
    return list_distance(a, b)


def bounded_edits(a: Column, b: Column, most: int) -> Column:
    """-1 above the bound."""
    return F.levenshtein(a, b, most)


def word_edits(a: Column, b: Column) -> Column:
    """Levenshtein distance between word lists, by the bit-parallel kernel: a pair costs its words of one side times a few
    operations on integers with a bit for each word of the other."""
    return list_distance(words(a), words(b))


def word_disagreement(a: Column, b: Column) -> Column:
    return word_edits(a, b) / F.greatest(F.size(words(a)), F.size(words(b)), F.lit(1))


def row_rate(edits: Column, length: Column, hyp_length: Column, empty_ref: str = "one") -> Column:
    """edits / length; for an empty reference 1 (0 if both are empty) with `one`, null with the other policies."""
    if empty_ref not in EMPTY_REF:
        raise ValueError(empty_ref)
    empty = F.when(hyp_length == 0, F.lit(0.0)).otherwise(F.lit(1.0)) if empty_ref == "one" else F.lit(None).cast("double")
    return F.when(length == 0, empty).otherwise(edits / length)
