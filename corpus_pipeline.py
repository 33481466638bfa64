"""A training-data pipeline over `documents`: language ID, toxicity, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept.  All but the last return the
columns of documents.  A document that mixing takes k times comes out as k rows.

Defined cases: rows with a null or empty text, or one without a letter, are rejected by the first stage as no language;
rows with a null id are kept, compared and drawn like others; of rows equal in every column, as of all copies, one
stays; ties for the row that stays go to the smaller id, then to the earlier row; very long texts pass whole; an empty
table gives no rows; columns beside those of documents are dropped by the first stage, so none can clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import langid, mixing, neardup, packing, toxicity
from corvane.llm.common import WORD, materialize, table
from corvane.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row"
#: Documents whose words have languages less certain than this are rejected, as are those without a letter.
LEAST_CERTAINTY = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(F.col("lang").isNotNull()))
    known = langid.identify(docs.select(*COLUMNS), model, certainty=True)
    return known.where((F.col("lang_pred") != "und") & (F.col("certainty") >= LEAST_CERTAINTY)).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _row, a number of each row's own.  It is written down with the rows, so every read sees the same ones;
    doc_id can be null or repeated."""
    return materialize(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest id, null ids last.  Rows without a word are
    copies only of rows equal in every column."""
    rows = numbered(docs)
    groups = neardup.cluster(rows.select(ROW, "text"), width=5, key=ROW).where("n_shingles > 0").select(ROW, "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW)
    kept = groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first).select(ROW)
    wordless = rows.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    kept = kept.union(wordless.groupBy(*COLUMNS).agg(F.min(ROW).alias(ROW)).select(ROW))
    return rows.join(kept, ROW, "left_semi").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn by id; those without one by a digest of their text, so that they do not share one draw."""
    rows = numbered(docs)
    drawn_by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    return mixing.take(rows, mixing.mix(rows, key=ROW, drawn_by=drawn_by), key=ROW).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors still hold memory of the stages before
    return packing.op2(docs, tokenizer_file("byte_bpe_50k.json"), remembered=150_000, at_once=1 << 20)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs


#: The fitted stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
