"""Normalization and string functions.  Everything but Unicode composition, full entity decoding and transliteration is
a built-in expression, so Catalyst sees through it."""

from __future__ import annotations

import html
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.batch import by_slices

# Code points dropped by each profile, and those a word may hold.
_DIGITS_AND_STOPS = "०-९।॥ऽॐ"
_VEDIC = "॒॑॓॔᳐-᳿"
_DEVANAGARI = "ऀ-ॿ"
_NAMED_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

PROFILES = ("base", "vedic", "canonical", "raw", "latin")


@by_slices(T.StringType())
def nfc(s):
    return None if s is None else unicodedata.normalize("NFC", s)


@by_slices(T.StringType())
def nfkd_ascii(s):
    return None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


@by_slices(T.StringType())
def unescape(s):
    """Every HTML entity."""
    return None if s is None else html.unescape(s)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda, an expression over outer columns would be computed
    again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space (Unicode's) to one space, ends stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def dedup_marks(c: Column) -> Column:
    """Consecutive equal combining marks become one."""
    return F.regexp_replace(c, r"([\p{Mn}\p{Mc}])\1+", "$1")


def fold_final_nasal(c: Column) -> Column:
    """A word-final m becomes anusvara."""
    return F.regexp_replace(c, r"म्(?=(?U:\s)|[।॥]|$)", "ं")


def fold_nasals(c: Column) -> Column:
    """Phonetic fold: candrabindu, nasal with virama before a consonant, and final m, all to anusvara."""
    c = F.regexp_replace(c, "ँ", "ं")
    c = F.regexp_replace(c, "[ङञणनम]्(?=[क-ह])", "ं")
    return F.regexp_replace(c, r"म्(?=\s|$)", "ं")


def unfold_anusvara(c: Column) -> Column:
    return F.replace(c, F.lit("ं"), F.lit("म्"))


def norm(c: Column, profile: str = "base", compose: bool = True) -> Column:
    """Normalize for scoring.  base: drop digits, stops, avagraha and om, keep Devanagari; vedic: drop accents too;
    canonical: vedic after folding doubled marks and final m; raw: keep digits and stops; latin: lower case, letters
    and marks of any script.  compose=False leaves out Unicode composition, the only Python step."""
    if profile not in PROFILES:
        raise ValueError(profile)
    c = nfc(c) if compose else c
    if profile == "latin":
        return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\s]", " "))
    if profile == "canonical":
        c = fold_final_nasal(dedup_marks(c))
    if profile != "raw":
        c = F.regexp_replace(c, f"[{_DIGITS_AND_STOPS}{'' if profile == 'base' else _VEDIC}]", " ")
    return squeeze(F.regexp_replace(c, rf"(?U)[^{_DEVANAGARI}\s]", " "))


def ascii_fold(c: Column) -> Column:
    """a-z words alone: what byte-based engines measure alike."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]", " "), " +", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def first_words(c: Column, n: int) -> Column:
    """The first n words: a feature of the reported pairs, which are turns cut to a scoring window."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    bare = F.regexp_replace(nfkd_ascii(c), r"(\.(mp3|wav|m4a|flac|ogg|opus|mp4))+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\W+", "_"), "^_+|_+$", "")


def range_set(c: Column) -> Column:
    """'13-16' to 13, 14, 15, 16; otherwise the numbers among the parts."""
    parts = F.transform(F.split(c.cast("string"), "-"), lambda x: F.trim(x))
    numbers = F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    whole = (F.size(parts) > 1) & first.rlike("^[0-9]+$") & last.rlike("^[0-9]+$") & (first.cast("int") <= last.cast("int"))
    return F.when(whole, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array_sort(F.array_distinct(numbers)))


def last_number(c: Column, digits: str = "೦೧೨೩೪೫೬೭೮೯") -> Column:
    """The last run of digits, foreign numerals folded."""
    runs = F.regexp_extract_all(F.translate(c, digits, "0123456789"), F.lit("([0-9]+)"))
    return F.try_element_at(runs, F.lit(-1)).cast("int")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def html_text(c: Column, every_entity: bool = False) -> Column:
    """Tags to spaces, then entities: the five common ones as expressions, or all of them."""
    c = strip_tags(c)
    if every_entity:
        return squeeze(unescape(c))
    for entity, char in _NAMED_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def body_start(c: Column, mark: str = "[āīūṛṝḷṃḥṅñṭḍṇśṣ]", least: int = 2) -> Column:
    """The text from the first line with enough marks on; all of it if there is none."""
    lines = F.split(c, "\n")
    rich = F.transform(lines, lambda x: F.regexp_count(x, F.lit(mark)) >= least)
    at = F.coalesce(F.array_position(rich, F.lit(True)), F.lit(0)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(lines, at, F.size(lines)), "\n")).otherwise(c)


def verses(c: Column, prose: bool = False) -> Column:
    return F.filter(F.transform(F.split(c, r"[।\n]+" if prose else r"॥|\n\s*\n"), lambda v: F.trim(v)), lambda v: v != "")


def numbered_verses(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"॥\s*[0-9०-९]+\s*॥"), lambda v: F.trim(v)), lambda v: v != "")


def chapters(c: Column) -> Column:
    """(number, body) of '=== CHAPTER n ===' sections."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"=== CHAPTER (\d+) ===")), lambda x: x.cast("int"))
    bodies = F.split(c, r"=== CHAPTER \d+ ===")
    return F.arrays_zip(numbers.alias("number"), F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))).alias("body"))


def verse_hint(c: Column) -> tuple[Column, Column]:
    """The inclusive verse range that a file name hints at; nulls if none."""
    pick = lambda i: F.nullif(F.regexp_extract(c, r"(?i)shlokas?\s*(\d+)\s*-\s*(\d+)", i), F.lit("")).cast("int")
    return pick(1), pick(2)


def hotwords(c: Column, least: int = 3) -> Column:
    """Distinct Devanagari runs of some length, sorted."""
    found = F.regexp_extract_all(c, F.lit(f"([{_DEVANAGARI}]+)"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: F.length(w) >= least)))


def char_tokens(c: Column) -> Column:
    """Characters joined by spaces, words by a bar: the language model's tokens."""
    return F.array_join(F.transform(words(c), lambda w: F.array_join(chars(w), " ")), " | ")


def has_latin(c: Column) -> Column:
    return c.rlike("[a-zA-Z]")


def low_variety(c: Column, least: float = 0.30) -> Column:
    """Few distinct characters for the length."""
    x = F.regexp_replace(c, " ", "")
    return F.coalesce(F.try_divide(F.size(F.array_distinct(chars(x))), F.length(x)) < least, F.lit(True))


def trigrams(w: Column) -> Column:
    run = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - 2), lambda i: F.array_join(F.slice(v, i, F.lit(3)), " "))
    return let(w, lambda v: F.when(F.size(v) >= 3, run(v)).otherwise(F.array().cast("array<string>")))


def degenerate(w: Column) -> Column:
    """A looping decode: 8 words or more, under half distinct, and one three-word phrase three times or more.  Sorting
    the phrases puts equal ones side by side, so the third of a kind equals the one two places before."""
    third = lambda t: F.exists(F.sequence(F.lit(3), F.greatest(F.size(t), F.lit(3))), lambda i: F.try_element_at(t, i) == F.try_element_at(t, i - 2))
    looped = lambda v: F.coalesce(let(F.array_sort(trigrams(v)), third), F.lit(False))
    poor = lambda v: (F.size(v) >= 8) & (F.size(F.array_distinct(v)) < 0.5 * F.size(v))
    return let(w, lambda v: F.when(poor(v), looped(v)).otherwise(F.lit(False)))


def valid_word(c: Column) -> Column:
    """Length 3 or more, a consonant, and not mostly viramas."""
    return (F.length(c) >= 3) & c.rlike("[क-ह]") & (F.length(c) - F.length(F.replace(c, F.lit("्"), F.lit(""))) <= 0.4 * F.length(c))


def first_rule(c: Column, rules: list[tuple[str, str]], kind: str = "prefix", default: str | None = None) -> Column:
    """The tag of the first rule that matches, by prefix or by substring."""
    out = F.lit(default)
    for mark, tag in reversed(rules):
        out = F.when(c.startswith(mark) if kind == "prefix" else F.contains(c, F.lit(mark)), F.lit(tag)).otherwise(out)
    return out


def any_prefix(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def first_field(c: Column, patterns: list[tuple[str, int]]) -> Column:
    """The first non-empty capture of a cascade of patterns."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, g), F.lit("")) for p, g in patterns))


def client_key(header: Column, forwarded: Column, socket: Column) -> Column:
    """The first non-empty of a header, the first item of a list header and the socket address."""
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(empty(header), empty(F.get(F.split(forwarded, ","), F.lit(0))), empty(socket), F.lit("?"))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return F.sqrt(F.coalesce(F.try_divide(total, F.size(samples)), F.lit(0.0)))
