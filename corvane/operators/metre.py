"""Verse analytics: metre, quarters, learning units, job deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import script
from corvane.functions.text import norm, verses


def scanned_verses(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per verse: its aksharas, weights and metre (length and name; null for prose, and where the number of
    weights is not that of the aksharas)."""
    v = df.select(key, F.posexplode(verses(F.col(text))).alias("verse", "body")).withColumn("clean", norm(F.col("body"), "canonical")).where("clean <> ''")
    v = v.withColumn("aksharas", script.akshara(F.col("clean"))).withColumn("weights", script.scansion(script.transliterate(F.col("clean"), "devanagari", "slp1")))
    found = F.when(F.length("weights") == F.size("aksharas"), script.metre(F.col("weights")))
    return v.withColumn("metre", found)


def pada_rows(scanned: DataFrame, key: str) -> DataFrame:
    """One row per quarter; prose is cut at stops and lines and tagged gadya."""
    metric = scanned.where("metre is not null").select(key, "verse", F.col("metre.name").alias("name"), F.posexplode(script.padas(F.col("aksharas"), F.col("metre.length"))).alias("pada", "aksharas")).withColumnRenamed("name", "metre")
    prose = scanned.where("metre is null").select(key, "verse", F.lit("gadya").alias("metre"), F.posexplode(verses(F.col("body"), prose=True)).alias("pada", "part"))
    prose = prose.withColumn("aksharas", script.akshara(norm(F.col("part"), "canonical"))).where(F.size("aksharas") > 0)
    prose = prose.withColumn("aksharas", F.get(script.padas(F.col("aksharas"), F.size("aksharas")), F.lit(0))).drop("part")
    return metric.unionByName(prose)


def units(padas: DataFrame, key: str, granularity: str = "pada") -> DataFrame:
    """Learning units: each quarter, consecutive pairs (ardha), or whole verses (full)."""
    size = {"pada": 1, "ardha": 2, "full": 1 << 30}[granularity]
    place = F.row_number().over(Window.partitionBy(key, "verse").orderBy("pada")) - 1
    grouped = padas.withColumn("unit", F.floor(place / size).cast("int")).groupBy(key, "verse", "unit")
    parts = F.sort_array(F.collect_list(F.struct("pada", "aksharas", "metre")))  # the quarters of one verse
    out = grouped.agg(parts.alias("p"))
    texts = F.transform("p", lambda x: script.unit_text(x["aksharas"]))
    return out.select(key, "verse", "unit", F.get("p", F.lit(0))["metre"].alias("metre"), F.flatten(F.transform("p", lambda x: x["aksharas"])).alias("aksharas"), F.array_join(texts, " ").alias("text"), F.array_join(texts, "\n").alias("tts_text"))


def render_jobs(units_: DataFrame, cached: DataFrame, seed: int = 60) -> DataFrame:
    """Distinct texts with the first metre seen, whose cache key is not there yet."""
    first = units_.groupBy("text").agg(F.min_by("metre", F.struct("verse", "unit")).alias("metre"))
    keyed = first.withColumn("key", F.substring(F.sha1(F.concat_ws("|", "text", "metre", F.lit(str(seed)))), 1, 16))
    return keyed.join(cached, "key", "left_anti")
