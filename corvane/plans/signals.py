"""Registered queries of signals, media containers, array files and the global shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.functions import signal
from corvane.operators import curate
from corvane.plans.catalog import query, t
from corvane.plans.stored import folder
from corvane.sources import media, npy, sinks


@query(
    "WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, [8000, 16000, 22050, 44100][(vec_id % 4 + 1)::INT] AS rate, vec_id // 4 % 2 + 1 AS ch FROM embeddings), "
    "m AS (SELECT vec_id, rate, CASE WHEN ch = 1 THEN e ELSE list_transform(range(0, len(e) // 2), lambda i: (e[2 * i + 1] + e[2 * i + 2]) / 2) END AS w FROM s), "
    "n AS (SELECT *, CASE WHEN rate = 16000 THEN len(w) ELSE floor(len(w) * 16000::DOUBLE / rate)::BIGINT END AS n FROM m) "
    "SELECT vec_id, n + 9600 AS n, list_transform(range(0, n), lambda i: w[least(floor(i * rate / 16000::DOUBLE)::BIGINT, len(w) - 1) + 1]) AS core, 0::DOUBLE AS ends FROM n"
)
def resampled_signals(spark, d):
    """Vectors as signals of one or two channels at four rates, brought to one channel at 16 kHz with silence around."""
    rate = F.element_at(F.array(*(F.lit(r) for r in (8000, 16000, 22050, 44100))), (F.col("vec_id") % 4 + 1).cast("int"))
    channels = (F.expr("vec_id div 4") % 2 + 1).cast("int")
    made = signal.prepared(F.col("embedding").cast("array<double>"), rate, channels)
    whole = t(spark, d, "embeddings").select("vec_id", made.alias("w"))
    ends = F.concat(F.slice("w", 1, 4800), F.slice("w", -4800, 4800))
    return whole.select("vec_id", F.size("w").cast("bigint").alias("n"), F.slice("w", F.lit(4801), F.size("w") - 9600).alias("core"), F.aggregate(ends, F.lit(0.0), lambda a, x: a + F.abs(x)).alias("ends"))


def _media(spark, d):
    """(path, content): a container of each vector, some broken, some with chunks before their samples."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind, samples = i % 8, [int(x * 1000) for x in v[: i % 50 + 10]]
                rate, channels = (8000, 1) if kind == 6 else (44100, 2) if kind == 1 else (16000, 1)
                tags = b"LIST" + (9999).to_bytes(4, "little") + b"t" * 10_000 if kind == 2 else b""
                content = media.wave_bytes(samples[: len(samples) // channels * channels], rate, channels, tags)
                if kind == 3:
                    content = content[: 44 + len(samples)]
                elif kind == 4:
                    content = b"ID3" + content[3:]
                elif kind == 5:
                    content = content[:36]
                elif kind == 6:
                    content = content[:40] + b"\xff" * 4 + content[44:]
                paths.append(f"{i}.wav")
                out.append(None if kind == 7 else content)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(out, pa.binary())], names=["path", "content"])

    return t(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(make, "path string, content binary")


@query(
    "SELECT vec_id || '.wav' AS path, CASE WHEN k IN (4, 5, 7) THEN 0 WHEN k = 1 THEN (n // 2 * 2)::DOUBLE * 2 / (44100 * 4) WHEN k = 3 THEN n::DOUBLE / 32000 WHEN k = 6 THEN n::DOUBLE * 2 / 16000 ELSE n::DOUBLE * 2 / 32000 END::DOUBLE AS duration, "
    "CASE WHEN ok THEN 'pcm_s16le' END AS codec, CASE WHEN ok THEN CASE k WHEN 1 THEN '44100' WHEN 6 THEN '8000' ELSE '16000' END END AS sr, CASE WHEN ok THEN CASE k WHEN 1 THEN '2' ELSE '1' END END AS ch, ok "
    "FROM (SELECT vec_id, vec_id % 8 AS k, least(vec_id % 50 + 10, len(embedding)) AS n, vec_id % 8 NOT IN (4, 5, 7) AS ok FROM embeddings)"
)
def probed_media(spark, d):
    """Containers stored in the shared folder and probed: duration, codec, rate and channels, 0.0 where that fails."""
    path = folder(spark, "media")
    sinks.overwrite(_media(spark, d), path)
    return media.probed(spark.read.parquet(path))


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, [vec_id::DOUBLE, embedding[1]::DOUBLE, embedding[4]::DOUBLE, embedding[5]::DOUBLE] AS picked FROM embeddings")
def array_files(spark, d):
    """Vectors written as array files, one for each range of ids, and some of their columns read again; each row has its
    place among the rows of all files in order of their names."""
    path = folder(spark, "arrays-npy")
    spark.dataSource.register(npy.ArrayFiles)
    rows = t(spark, d, "embeddings").select("vec_id", F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("values"))
    rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select("values").write.format("npy").mode("append").save(path)
    read = spark.read.format("npy").option("columns", "0-1,4-5").option("rows", 50).load(path)
    placed = curate.running(read, {"place": F.lit(1)}, "path", "row")
    return placed.select(F.col("values")[0].cast("bigint").alias("vec_id"), F.col("place").cast("bigint").alias("place"), F.col("values").alias("picked"))


def shuffle_sql(source: str, place: str, seed: int = 7, rounds: int = 6) -> str:
    """A recursive query: every row's walk, step by step, until it is below the number of rows."""
    body = f"SELECT {place} AS p, {place} // a AS u, {place} % a AS v, a, b, n FROM {source}"
    for k in range(rounds):
        for side, other, m, r in (("u", "v", "b", 2 * k), ("v", "u", "a", 2 * k + 1)):
            body = f"SELECT *, ({other} * 1103515245 + {(r * 12345 + seed * 40503 + 1) % (1 << 31)}) % 2147483648 AS y FROM ({body})"
            body = f"SELECT * EXCLUDE (y), (xor(y, y >> 15) * 22695477 + 1) % 2147483648 AS z FROM ({body})"
            body = f"SELECT * EXCLUDE ({side}, z), ({side} + (z >> 5) % {m}) % {m} AS {side} FROM ({body})"
    return f"SELECT p, u * a + v AS x, a, b, n FROM ({body})"


_GRID = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, (SELECT count(*) FROM documents) AS n FROM documents"
_SHUFFLE = f"""g AS (SELECT *, ceil(sqrt(n::DOUBLE))::BIGINT AS a, ((n - 1) // ceil(sqrt(n::DOUBLE))::BIGINT + 1)::BIGINT AS b FROM ({_GRID})),
wk AS (SELECT p AS first, x, a, b, n FROM ({shuffle_sql('g', 'place')})
  UNION ALL SELECT first, x, a, b, n FROM (SELECT o.first, s.* FROM (SELECT * FROM wk WHERE x >= n) o JOIN ({shuffle_sql('(SELECT DISTINCT range AS cell, g.a, g.b, g.n FROM (SELECT DISTINCT a, b, n FROM g) g, range(0, 100000) WHERE range >= g.n AND range < g.a * g.b)', 'cell')}) s ON s.p = o.x))"""


@query(f"WITH RECURSIVE {_SHUFFLE} SELECT doc_id, place::BIGINT AS place, x AS shuffled FROM g JOIN wk ON wk.first = g.place WHERE x < wk.n")
def shuffled_rows(spark, d):
    """Every document's place in a global seeded shuffle, found from its place in order of ids."""
    docs = t(spark, d, "documents").select("doc_id")
    placed = curate.running(docs, {"place": F.lit(1)}, "doc_id").withColumn("place", F.col("place").cast("bigint"))
    return curate.shuffled(placed, "place", docs.count())
