"""Readers with explicit schemas, and the canonical utterance adapter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import alnum_key

UTTERANCE = "utt_id string, text string, duration double, speaker string, work string, source string, lang string, meta map<string,string>"
FILE_MAP = "id string, orig string, wav string, ok boolean, work string, speaker string, skandha int, adhyaya string, duration_s double, sr string, ch string, codec string"
DOCUMENT = "content map<string, array<struct<adhyaya:int, verse:string, text:array<string>>>>"
SESSION = "source_file string, blocks array<struct<id:string, start_ms:bigint, end_ms:bigint>>"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every line must parse."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines are skipped."""
    wide = T._parse_datatype_string(schema).add("_corrupt", T.StringType())
    kept = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # the corrupt column may not be the only one read
    return kept.where(F.col("_corrupt").isNull()).drop("_corrupt")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def document_verses(spark: SparkSession, path: str, chapters: list[int] | None = None, verse_range: tuple | None = None) -> DataFrame:
    """(adhyaya, verse, text) of a nested document in reading order; a verse that is no number sorts last."""
    return flatten_document(json_array(spark, path, DOCUMENT), chapters, verse_range)


def flatten_document(docs: DataFrame, chapters: list[int] | None = None, verse_range: tuple | None = None) -> DataFrame:
    entries = docs.select(F.explode(F.map_values("content")).alias("e")).select(F.explode("e").alias("v"))
    out = entries.select("v.adhyaya", F.when(F.col("v.verse").rlike("^[0-9]+$"), F.col("v.verse").cast("int")).alias("verse"), F.array_join("v.text", " ").alias("text"))
    if chapters is not None:
        out = out.where(F.col("adhyaya").isin(chapters))
    if verse_range is not None:
        out = out.where(F.col("verse").between(*verse_range))
    return out.orderBy("adhyaya", F.col("verse").asc_nulls_last())


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The first tab-separated column of lines that are neither blank nor comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.trim(F.get(F.split("value", "\t"), F.lit(0))).alias("value"))


def files(spark: SparkSession, path: str, suffix: str, without: tuple = ()) -> DataFrame:
    """(path, content) of files below a folder, minus those whose path holds any of the given strings."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    for part in without:
        f = f.where(~F.col("path").contains(part))
    return f.select("path", "content")


def file_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """(name, path): by normalised base name, the first path wins."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return paths.groupBy(alnum_key(base).alias("name")).agg(F.min(path).alias("path"))


def utterances(df: DataFrame, source: str | None = None) -> DataFrame:
    """The canonical schema, with names that producers differ in brought together and the speaker derived where it is
    missing: the file's base name without its last number."""
    has = lambda *names: [F.col(n) for n in names if n in df.columns]
    first = lambda kind, *names: F.coalesce(*has(*names), F.lit(None)).cast(kind)
    path = first("string", "audio_filepath", "audio", "wav")
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    known = {"utt_id", "id", "text", "duration", "dur", "duration_s", "speaker", "work", "source", "src", "lang", "audio_filepath", "audio", "wav"}
    rest = [c for c in df.columns if c not in known]
    meta = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))) if rest else F.lit(None).cast("map<string,string>")
    return df.select(
        F.coalesce(first("string", "utt_id", "id"), base).alias("utt_id"), first("string", "text").alias("text"), first("double", "duration", "dur", "duration_s").alias("duration"),
        F.coalesce(first("string", "speaker"), F.regexp_replace(base, r"_\d+$", "")).alias("speaker"), first("string", "work").alias("work"),
        F.coalesce(first("string", "source", "src"), F.lit(source)).alias("source"), first("string", "lang").alias("lang"), meta.alias("meta"),
    )


def session_blocks(sessions: DataFrame, documents: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Blocks of sessions joined to the text of their source document by block id, shifted by the session's offset (none:
    0).  documents: (source_file, content)."""
    blocks = sessions.select("source_file", F.explode("blocks").alias("b")).select("source_file", F.col("b.id").alias("block"), F.col("b.start_ms").alias("start_ms"), F.col("b.end_ms").alias("end_ms"))
    texts = documents.select("source_file", F.explode("content").alias("block", "e")).select("source_file", "block", F.array_join(F.flatten(F.transform("e", lambda v: v["text"])), " ").alias("text"))
    joined = blocks.join(texts, ["source_file", "block"])
    shift = F.lit(0.0)
    if offsets is not None:
        joined = joined.join(offsets.select("source_file", "offset"), "source_file", "left")
        shift = F.coalesce("offset", F.lit(0.0))
    return joined.select("source_file", "block", "text", (F.col("start_ms") / 1000 + shift).alias("start"), (F.col("end_ms") / 1000 + shift).alias("end"))


def with_report(jobs: DataFrame, texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is known and found, and the others with why not."""
    j = jobs.join(texts.withColumn("_found", F.lit(True)), key, "left")
    why = F.when(F.col(key).isNull(), "no key").when(F.col("_found").isNull(), "no text")
    return j.where(why.isNull()).drop("_found"), j.where(why.isNotNull()).select(*jobs.columns, why.alias("why"))


def equal_length(a: DataFrame, b: DataFrame) -> None:
    x, y = a.count(), b.count()
    if x != y:
        raise ValueError(f"lengths differ: {x} and {y}")


def pipe_lines(*fields: Column, title: Column, cut: int = 90) -> Column:
    return F.concat_ws("|", *(f.cast("string") for f in fields), F.substring(title, 1, cut))


def enriched(df: DataFrame, call: Callable[[str], str], column: str, out: str, rows: int = 64) -> DataFrame:
    """df with what a service or a probe says of a column, '' where it fails: a hook for remote transcribers and media
    probes.  `call` is sent to the tasks; a null is not asked."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])

    def ask(value):
        try:
            return "" if value is None else call(value)
        except Exception:  # any failure of the other side is an empty answer
            return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                kept = [c for c in part.schema.names if c != out]
                said = pa.array([ask(v) for v in part.column(part.schema.get_field_index(column)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), said], names=[*kept, out])

    return df.mapInArrow(run, schema)


def http_call(url: str, timeout: float = 30.0) -> Callable[[str], str]:
    """A call for `enriched`: posts the value to a service and gives its answer's `raw_text`; what is no answer fails."""

    def call(value: str) -> str:
        import json
        from urllib.request import Request, urlopen

        with urlopen(Request(url, value.encode(), {"Content-Type": "text/plain; charset=utf-8"}), timeout=timeout) as answer:
            return str(json.load(answer).get("raw_text") or "")

    return call
