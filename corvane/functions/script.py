"""Script detection, transliteration, akshara segmentation and scansion."""

from __future__ import annotations

from string import ascii_letters

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let

# Unicode blocks of Indic scripts, in registry order.
BLOCKS = {
    "devanagari": 0x0900, "bengali": 0x0980, "gurmukhi": 0x0A00, "gujarati": 0x0A80, "oriya": 0x0B00, "tamil": 0x0B80, "telugu": 0x0C00, "kannada": 0x0C80,
    "malayalam": 0x0D00, "sinhala": 0x0D80, "grantha": 0x11300,
}
# Scripts whose blocks follow the Devanagari layout code point by code point.
_PARALLEL = ("bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada", "malayalam", "grantha")

# Roman letters in the order of the Devanagari letters below.
_VOWELS = "अ आ इ ई उ ऊ ऋ ॠ ऌ ॡ ए ऐ ओ औ".split()
_SIGNS = ["", *"ा ि ी ु ू ृ ॄ ॢ ॣ े ै ो ौ".split()]
_CONSONANTS = "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split()
_MARKS = "ं ः ँ ऽ । ॥".split()
_ROMAN = {
    "iast": (
        "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(),
        "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ".split(),
        "ṃ ḥ m̐ ' . ..".split(),
    ),
    "slp1": (
        "a A i I u U f F x X e E o O".split(),
        "k K g G N c C j J Y w W q Q R t T d D n p P b B m y r l v S z s h L".split(),
        "M H ~ ' . ..".split(),
    ),
    "hk": (
        "a A i I u U R RR lR lRR e ai o au".split(),
        "k kh g gh G c ch j jh J T Th D Dh N t th d dh n p ph b bh m y r l v z S s h L".split(),
        "M H ~ ' . ..".split(),
    ),
    "itrans": (
        "a A i I u U RRi RRI LLi LLI e ai o au".split(),
        "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h L".split(),
        "M H .N .a . ..".split(),
    ),
    "velthuis": (
        "a aa i ii u uu .r .R .l .L e ai o au".split(),
        "k kh g gh \"n c ch j jh ~n .t .th .d .dh .n t th d dh n p ph b bh m y r l v \"s .s s h L".split(),
        ".m .h / .a | ||".split(),
    ),
}
_ROMAN["kolkata"] = _ROMAN["iast"]
_ALIASES = {"itrans": {"aa": "A", "ii": "I", "uu": "U", "shh": "Sh", "w": "v"}}
VIRAMA = "्"
_SHIFT_LIMIT = 0x80

# Metres by the weights of a quarter, in registry order.
METRES = (
    ("GGLGGLLGLGG", "indravajrā"), ("LGLGGLLGLGG", "upendravajrā"), ("LGLGGLLGLGLG", "vaṃśastha"), ("GGLGLLLGLLGLGG", "vasantatilakā"), ("LLLLLLGGGLGGLGG", "mālinī"),
    ("GGGGLLLLLGGLGGLGG", "mandākrāntā"), ("LGGGGGLLLLLGGLLLG", "śikhariṇī"), ("LGLLLGLGLLLGLGGLG", "pṛthvī"), ("GGGLLGLGLLLGGGLGGLG", "śārdūlavikrīḍita"),
    ("GGGGLGGLLLLLLGGLGGLGG", "sragdharā"),
)


def detect_script(c: Column, roman: str = "iast", fallback: str = "devanagari") -> Column:
    """A Roman scheme where there is a Latin letter; else the block with most characters, ties by registry order."""
    count = lambda lo: F.regexp_count(c, F.lit(f"[\\x{{{lo:x}}}-\\x{{{lo + _SHIFT_LIMIT - 1:x}}}]"))
    scored = F.array(*(F.struct(count(lo).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("s")) for i, (name, lo) in enumerate(BLOCKS.items())))
    best = F.array_max(scored)
    return F.when(c.rlike("[A-Za-z]"), F.lit(roman)).when(best["n"] > 0, best["s"]).otherwise(F.lit(fallback))


def _roman_reader(scheme: str):
    vowels, consonants, marks = _ROMAN[scheme]
    table = {r: ("v", i) for i, r in enumerate(vowels)} | {r: ("c", i) for i, r in enumerate(consonants)} | {r: ("m", i) for i, r in enumerate(marks)}
    table |= {alias: table[r] for alias, r in _ALIASES.get(scheme, {}).items()}
    longest = max(map(len, table))

    def read(text: str) -> str:
        out, i, open_ = [], 0, False  # open_: a consonant still waits for its vowel
        while i < len(text):
            size = next((n for n in range(min(longest, len(text) - i), 0, -1) if text[i : i + n] in table), 0)
            kind, k = table[text[i : i + size]] if size else ("", 0)
            if kind == "v":
                out.append(_SIGNS[k] if open_ else _VOWELS[k])
                open_ = False
            else:
                if open_:
                    out.append(VIRAMA)
                open_ = kind == "c"
                out.append(_CONSONANTS[k] if kind == "c" else _MARKS[k] if kind == "m" else text[i])
            i += size or 1
        return "".join(out) + VIRAMA * open_

    return read


def _roman_writer(scheme: str):
    vowels, consonants, marks = _ROMAN[scheme]
    cons, sign = dict(zip(_CONSONANTS, consonants)), dict(zip(_SIGNS[1:], vowels[1:]))
    plain = dict(zip(_VOWELS, vowels)) | dict(zip(_MARKS, marks)) | {chr(0x0966 + i): str(i) for i in range(10)}

    def write(text: str) -> str:
        out, inherent = [], False
        for ch in text:
            if inherent and ch not in sign and ch != VIRAMA:
                out.append(vowels[0])
            inherent = ch in cons
            out.append(cons.get(ch) or sign.get(ch) or ("" if ch == VIRAMA else plain.get(ch, ch)))
        return "".join(out) + vowels[0] * inherent

    return write


def converter(source: str, target: str):
    """A function between two scripts through Devanagari; unknown scripts are identity."""

    def shift(lo: int, to: int):
        return lambda s: "".join(chr(ord(ch) - lo + to) if lo <= ord(ch) < lo + _SHIFT_LIMIT and ch not in "।॥" else ch for ch in s)

    def step(name: str, reading: bool):
        if name in _ROMAN:
            return _roman_reader(name) if reading else _roman_writer(name)
        if name in _PARALLEL:
            return shift(BLOCKS[name], 0x0900) if reading else shift(0x0900, BLOCKS[name])
        return lambda s: s

    into, out = step(source, True), step(target, False)
    return lambda s: out(into(s))


def transliterate(c: Column, source: str, target: str = "devanagari") -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(converter(source, target), na_action="ignore")

    return run(c)


def to_devanagari(c: Column, scheme: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series, names: pd.Series) -> pd.Series:
        made = {n: converter(n, "devanagari") for n in names.dropna().unique()}
        return pd.Series([x if x is None or n not in made else made[n](x) for x, n in zip(s, names, strict=True)])

    return run(c, scheme)


_BASE = r"\x{905}-\x{939}\x{958}-\x{961}\x{972}-\x{97F}"


def akshara(c: Column) -> Column:
    """Array of (text, word_end) clusters of normalised Devanagari: a base opens a cluster unless a virama precedes it;
    a final vowel-less cluster joins the one before it, across a space too."""
    none = F.array().cast("array<struct<text:string,word_end:boolean>>")
    word = lambda w: F.filter(F.regexp_extract_all(w, F.lit(f"((?:(?<!{VIRAMA})[{_BASE}]|^[^{_BASE}])(?:[^{_BASE}]|(?<={VIRAMA})[{_BASE}])*)")), lambda x: x != "")

    def clusters(w: Column) -> Column:
        return let(word(w), lambda a: F.transform(a, lambda x, i: F.struct(x.alias("text"), (i == F.size(a) - 1).alias("word_end"))))

    raw = F.flatten(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), clusters))

    # where a group begins is known from each cluster's own ending, so groups are cut out once
    heads = lambda a: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | ~x["text"].endswith(VIRAMA), i)), lambda i: i.isNotNull())

    def group(a: Column, at: Column) -> Column:
        part = lambda i, k: F.slice(a, i + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - i)
        return F.transform(at, lambda i, k: let(part(i, k), lambda g: F.struct(F.array_join(F.transform(g, lambda x: x["text"]), "").alias("text"), F.element_at(g, -1)["word_end"].alias("word_end"))))

    return F.coalesce(let(raw, lambda a: let(heads(a), lambda at: group(a, at))), none)


_SLP1_VOWELS, _SLP1_MARKS = "aiufxAIUFXeEoO", "MH~"
#: Listed one by one: Java's classes of ranges take several times the time of a set of characters.
_SLP1_LETTERS = ascii_letters + "~"


def scansion(slp1: Column) -> Column:
    """L or G of each vowel of SLP1 text: G if long, before a mark, or before two consonants.  Whole texts are replaced in
    place, light syllables first, since an array of syllables costs many times that."""
    v = _SLP1_VOWELS
    s = F.regexp_replace(F.regexp_replace(slp1, f"[^{_SLP1_LETTERS}]+", ""), f"^[^{v}]+", "")
    light = F.regexp_replace(s, rf"[aiufx][^{v}{_SLP1_MARKS}]?(?=[{v}]|\z)", "0")
    return F.replace(F.regexp_replace(light, f"[{v}][^{v}0]*", "G"), F.lit("0"), F.lit("L"))


def _agrees(w: Column, length: int | Column, pattern: Column) -> Column:
    """Equal weights but for the last, which is free."""
    return F.substring(w, F.lit(1), F.lit(length) - 1 if isinstance(length, int) else length - 1) == F.substring(pattern, F.lit(1), F.length(pattern) - 1)


def metre(w: Column) -> Column:
    """(length, name) of the quarter of a weight string; null for prose."""
    n = F.length(w)
    pair = lambda size, name: F.struct(size.cast("int").alias("length"), name.alias("name"))
    tests = []
    for pattern, name in METRES:
        size = len(pattern)
        fits = n.isin(size, 2 * size, 4 * size) & _agrees(w, size, F.lit(pattern))
        tests.append((fits, pair(F.lit(size), F.lit(name))))
    tests.append((n.isin(8, 16, 32), pair(F.lit(8), F.lit("anuṣṭubh"))))
    for parts in (4, 2):
        size = F.floor(n / parts).cast("int")
        quarter = lambda p: F.substring(w, size * p + 1, size - 1)  # noqa: B023, E731
        same = F.lit(True)
        for p in range(1, parts):
            same = same & (quarter(p) == quarter(0))
        tests.append(((n % parts == 0) & size.between(5, 30) & same, pair(size, F.concat(F.lit("sama-"), size.cast("string")))))
    out = F.lit(None).cast("struct<length:int,name:string>")
    for ok, value in reversed(tests):
        out = F.when(ok, value).otherwise(out)
    return out


def padas(aksharas: Column, length: Column) -> Column:
    """Aksharas in groups of a length, the last of each marked as a word end."""
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / length).cast("int")), lambda i: F.slice(a, i * length + 1, length))
    groups = let(aksharas, cut)
    close = lambda g: F.transform(g, lambda x, i: F.struct(x["text"].alias("text"), (x["word_end"] | (i == F.size(g) - 1)).alias("word_end")))
    return F.when(F.size(aksharas) > 0, F.transform(groups, close)).otherwise(F.array().cast("array<array<struct<text:string,word_end:boolean>>>"))


def unit_text(aksharas: Column) -> Column:
    return F.trim(F.array_join(F.transform(aksharas, lambda a: F.concat(a["text"], F.when(a["word_end"], " ").otherwise(""))), ""))
