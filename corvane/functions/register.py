"""SQL names of the functions that SQL users call."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.align import char_ops, match_ratio, trace
from corvane.functions.script import converter


def register(spark: SparkSession) -> list[str]:
    """Registers nfc, html_unescape, transliterate, match_ratio, align_ops (an array) and align_rows (a table)."""

    @F.pandas_udf(T.StringType())
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    @F.pandas_udf(T.StringType())
    def html_unescape(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    @F.pandas_udf(T.StringType())
    def transliterate(s: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        made: dict = {}
        out = []
        for x, a, b in zip(s, source, target, strict=True):
            if (a, b) not in made:
                made[a, b] = converter(a, b)
            out.append(None if x is None else made[a, b](x))
        return pd.Series(out)

    @F.udtf(returnType="op string, ri int, hi int")
    class AlignRows:
        def eval(self, ref: str, hyp: str):
            yield from trace(ref or "", hyp or "")

    for name, f in (("nfc", nfc), ("html_unescape", html_unescape), ("transliterate", transliterate), ("match_ratio", match_ratio), ("align_ops", char_ops)):
        spark.udf.register(name, f)
    spark.udtf.register("align_rows", AlignRows)
    return ["nfc", "html_unescape", "transliterate", "match_ratio", "align_ops", "align_rows"]
