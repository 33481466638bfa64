"""Registered queries that write files into the shared folder and read them back, and streams over whole tables."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import curate
from corvane.plans.catalog import query, t
from corvane.sources import readers, sinks
from corvane.streaming import progress, quota, stateful


def folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/stored/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ files


@query("SELECT doc_id, lang, n_chars FROM documents")
def jsonl_with_broken_lines(spark, d):
    """Lines of JSON with broken ones among them, which are skipped."""
    path = folder(spark, "lines")
    rows = t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    sinks.overwrite(rows, path, "json")
    rows.where("doc_id % 50 = 0").select(F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "lang')).alias("value")).write.mode("append").text(path)
    return readers.jsonl_tolerant(spark, path, "doc_id bigint, lang string, n_chars bigint")


@query("SELECT doc_id, source, 'second' AS batch FROM documents UNION ALL SELECT doc_id, source, 'first' FROM documents WHERE n_chars > 1000")
def jsonl_appended(spark, d):
    """A log written in two batches and read strictly."""
    path = folder(spark, "log")
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    sinks.append(rows.where("n_chars > 1000").select("doc_id", "source", F.lit("first").alias("batch")), path)
    sinks.append(rows.select("doc_id", "source", F.lit("second").alias("batch")), path)
    return readers.jsonl(spark, path, "doc_id bigint, source string, batch string")


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def json_arrays(spark, d):
    """Documents that are arrays of turns, each with those of some whole conversations."""
    path = folder(spark, "arrays")
    c = t(spark, d, "conversations")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "conv_id"))).alias("turns"))  # the turns of one conversation
    files = max(1, c.select("conv_id").distinct().count() // 100)  # a file is one array of the turns of about a hundred conversations
    dealt = turns.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(files)).alias("part")).agg(F.to_json(F.flatten(F.collect_list("turns"))).alias("value"))
    dealt.write.partitionBy("part").text(path)
    return readers.json_array(spark, f"{path}/*", "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("SELECT conv_id, (turn % 4 + 1)::INT AS adhyaya, CASE WHEN turn % 7 > 0 THEN turn::INT END AS verse, text || ' ' || role AS text FROM conversations WHERE turn % 4 + 1 IN (1, 3) AND (turn % 7 > 0 AND turn BETWEEN 1 AND 20)")
def nested_verses(spark, d):
    """Nested documents flattened to verses, by chapter and verse range."""
    c = t(spark, d, "conversations")
    verse = F.struct((F.col("turn") % 4 + 1).cast("int").alias("adhyaya"), F.when(F.col("turn") % 7 > 0, F.col("turn").cast("string")).otherwise("end").alias("verse"), F.array("text", "role").alias("text"))
    # a conversation's id goes with each text, since flattening keeps verses alone
    marked = verse.withField("text", F.array(F.concat(F.col("conv_id").cast("string"), F.lit("|"), "text"), "role"))
    docs = c.groupBy("conv_id").agg(F.create_map(F.lit("turns"), F.collect_list(marked)).alias("content"))
    flat = readers.flatten_document(docs.select("content"), [1, 3], (1, 20))
    return flat.select(F.split("text", "[|]", 2)[0].cast("bigint").alias("conv_id"), "adhyaya", "verse", F.split("text", "[|]", 2)[1].alias("text"))


@query("SELECT doc_id::VARCHAR AS value FROM documents")
def commented_lines(spark, d):
    """The first column of lines, without comments and blanks."""
    path = folder(spark, "text")
    docs = t(spark, d, "documents")
    docs.select(F.explode(F.array(F.lit("# comment"), F.lit("  "), F.concat_ws("\t", "doc_id", "source", F.lit("#")))).alias("value")).write.text(path)
    return readers.text_lines(spark, path)


@query("SELECT lang, n FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) WHERE lang <> 'fr'")
def found_files(spark, d):
    """Documents whose language has a file in a folder tree, one branch left out: the files are indexed by base name."""
    path = folder(spark, "tree")
    langs = t(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    langs.select("lang", F.lit("x").alias("value")).write.partitionBy("lang").text(path)
    found = readers.files(spark, path, ".txt", without=("lang=fr",)).select("path")
    index = found.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).distinct()
    return langs.join(index, "lang", "left_semi")


@query("SELECT regexp_replace(lower(regexp_extract(url, '([^/]+)$', 1)), '[^a-z0-9]', '', 'g') AS name, min(url) AS path FROM (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') || '.htm' AS url FROM pages) GROUP BY ALL".replace("lower(regexp_extract(url, '([^/]+)$', 1))", "lower(regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]*$', ''))"))
def files_by_name(spark, d):
    """By normalised base name the first path."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    return readers.file_index(t(spark, d, "pages").select(F.concat(bare, F.lit(".htm")).alias("path")))


@query(
    "SELECT cut, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents, (SELECT unnest([0.1, 0.3]::DOUBLE[]) AS cut) WHERE (doc_id * 37 % 101) / 100.0::DOUBLE <= cut GROUP BY cut"
)
def scored_and_cut(spark, d):
    """All rows are stored with their scores, once; gates are views of that table and can be cut anew."""
    path = folder(spark, "scored")
    made = lambda: t(spark, d, "documents").select("doc_id", "n_chars", ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("score"))
    sinks.once(spark, path, made)
    gates = [sinks.gate_view(sinks.once(spark, path, made), F.col("score") <= cut).select(F.lit(cut).alias("cut"), "n_chars") for cut in (0.1, 0.3)]
    return gates[0].union(gates[1]).groupBy("cut").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def deferred_stage(spark, d):
    """A stage that waits for the table of a job that runs beside it."""
    path = folder(spark, "deferred")
    job = threading.Thread(target=lambda: t(spark, d, "documents").select("source", "n_chars").write.parquet(path))
    job.start()
    rows = sinks.when_there(spark, path, poll=0.1, timeout=600.0)
    job.join()
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id::VARCHAR || '|' || source || '|' || substr(text, 1, 90) AS line FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def metadata_lines(spark, d):
    docs = t(spark, d, "documents").where("source is not null and text is not null")
    return docs.select(readers.pipe_lines(F.col("doc_id"), F.col("source"), title=F.col("text")).alias("line"))


@query("SELECT doc_id, CASE WHEN l.quality IS NOT NULL AND l.toxic = 0 THEN 'q' || l.quality ELSE d.lang END AS lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)")
def patched_rows(spark, d):
    over = t(spark, d, "labels").select("doc_id", F.when((F.col("toxic") == 0) & F.col("quality").isNotNull(), F.concat(F.lit("q"), "quality")).alias("lang"))
    return curate.patched(t(spark, d, "documents").select("doc_id", "lang", "source"), over, "doc_id")


@query(
    "SELECT 'u_' || doc_id AS utt_id, text, n_chars / 100.0::DOUBLE AS duration, 'u' AS speaker, NULL::VARCHAR AS work, 'driver' AS source, lang, source AS kind FROM documents WHERE doc_id % 2 = 0 "
    "UNION ALL SELECT doc_id::VARCHAR, text, n_chars / 100.0::DOUBLE, 'someone', source, 'other', lang, NULL FROM documents WHERE doc_id % 2 = 1"
)
def canonical_utterances(spark, d):
    """Two producers with other names, brought to one schema."""
    docs = t(spark, d, "documents").withColumn("seconds", F.col("n_chars") / F.lit(100.0))
    a = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("/data/u_"), "doc_id", F.lit(".wav")).alias("audio_filepath"), "text", F.col("seconds").alias("dur"), "lang", F.col("source").alias("kind"))
    b = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), "text", F.col("seconds").alias("duration_s"), F.lit("someone").alias("speaker"), F.col("source").alias("work"), F.lit("other").alias("src"), "lang")
    both = readers.utterances(a, "driver").unionByName(readers.utterances(b))
    return both.withColumn("kind", F.col("meta")["kind"]).drop("meta")


# ------------------------------------------------------------------ streams


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY event_type")
def stream_statistics(spark, d):
    """Deltas of each micro-batch, summed."""
    deltas = quota.run_to_table(stateful.session_counts(events(spark, d), "event_type", "user_id"), "stream_statistics")
    return deltas.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


@query(
    "WITH c AS (SELECT * FROM events WHERE event_id % 5 > 0 AND event_type IN ('view', 'click')), g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000, true)::INT AS new FROM c), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end_, count(*) AS n FROM s GROUP BY user_id, session"
)
def stream_sessions(spark, d):
    """Sessions of consented events of two kinds: those that the watermark has closed, and those still open at the end."""
    e = quota.consented(events(spark, d).withColumn("consent", F.col("event_id") % 5 > 0), "consent", "event_type", ("view", "click"))
    s = quota.sessions(e, "user_id", "ts", "6 hours", "stream_sessions")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_"), "n")


@query("SELECT user_id, event_id AS seq, list_transform(range(1, greatest(max(event_id * 7919 % 12 - 3) OVER (PARTITION BY user_id ORDER BY event_id), 0) + 1), lambda i: 'w' || i) AS locked FROM events")
def stream_partials(spark, d):
    """Partial hypotheses of sessions: the words that are locked after each."""
    n = (F.col("event_id") * 7919 % 12).cast("int")
    words = F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("w"), i)), " ")
    e = events(spark, d).select("user_id", "event_id", words.alias("text"))
    return quota.run_to_table(quota.partial_commit(e, "user_id", "event_id", "text"), "stream_partials")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, (event_id % 7 + 1)::DOUBLE / 2 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events), "
    "s AS (SELECT user_id, n, ms, event_id AS first, event_id AS last, sec AS held, 0::BIGINT AS segment, sec >= 10 AS full_, NULL::BIGINT AS c_first, NULL::BIGINT AS c_last, NULL::DOUBLE AS c_held FROM e WHERE n = 1 "
    "UNION ALL SELECT e.user_id, e.n, e.ms, CASE WHEN full_ OR gone THEN e.event_id ELSE first END, e.event_id, CASE WHEN full_ OR gone THEN sec ELSE held + sec END, CASE WHEN full_ OR gone THEN segment + 1 ELSE segment END, "
    "CASE WHEN full_ OR gone THEN sec ELSE held + sec END >= 10, CASE WHEN gone THEN first END, CASE WHEN gone THEN last END, CASE WHEN gone THEN held END FROM (SELECT s.*, NOT full_ AND e.ms - s.ms >= 21600000 AS gone FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) "
    "SELECT user_id, segment, first, last, held AS seconds, 'full' AS flushed FROM s WHERE full_ UNION ALL SELECT user_id, segment - 1, c_first, c_last, c_held, 'idle' FROM s WHERE c_first IS NOT NULL "
    "UNION ALL SELECT user_id, segment, first, last, held, 'idle' FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1) WHERE NOT full_ AND ms + 21600000 <= (SELECT max(epoch_ms(ts)) FROM events) - 3600000"
)
def stream_segments(spark, d):
    """Segments flushed whenever a session holds ten seconds, or when nothing has come for six hours."""
    e = events(spark, d).select("user_id", "ts", "event_id", ((F.col("event_id") % 7 + 1).cast("double") / 2).alias("sec"))
    return quota.run_to_table(stateful.bounded_segments(e, "user_id", "ts", "event_id", "sec", idle="6 hours", delay="1 hour"), "stream_segments")


@query(
    "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY manifest ORDER BY seq) AS n FROM (SELECT user_id % 5 AS manifest, event_id AS seq, event_id * 7 AS ms, 'w' || (event_id // 7 % 6) AS worker, ['add', 'next', 'save', 'next'][(event_id % 4 + 1)::INT] AS action, "
    "CASE event_id % 4 WHEN 0 THEN 'i' || event_id WHEN 2 THEN 'i' || (event_id // 8 * 4) END AS item FROM events)), "
    "q AS (SELECT manifest, 0::BIGINT AS n, []::VARCHAR[] AS items, []::VARCHAR[] AS who, []::BIGINT[] AS since, []::BOOLEAN[] AS done, []::VARCHAR[] AS early, NULL::BIGINT AS seq, NULL::VARCHAR AS worker, NULL::VARCHAR AS action, NULL::INT AS pick FROM (SELECT DISTINCT manifest FROM e) "
    "UNION ALL SELECT manifest, n, CASE WHEN action = 'add' AND place IS NULL THEN items || [item] ELSE items END, "
    "CASE WHEN action = 'add' AND place IS NULL THEN who || [''] WHEN action = 'save' AND place IS NOT NULL THEN who[:place - 1] || [''] || who[place + 1:] WHEN pick IS NOT NULL THEN who[:pick - 1] || [worker] || who[pick + 1:] ELSE who END, "
    "CASE WHEN action = 'add' AND place IS NULL THEN since || [0] WHEN pick IS NOT NULL THEN since[:pick - 1] || [ms] || since[pick + 1:] ELSE since END, "
    "CASE WHEN action = 'add' AND place IS NULL THEN done || [list_contains(early, item)] WHEN action = 'save' AND place IS NOT NULL THEN done[:place - 1] || [true] || done[place + 1:] ELSE done END, "
    "CASE WHEN action = 'save' AND place IS NULL THEN early || [item] ELSE early END, seq, worker, action, pick FROM ("
    "SELECT q.manifest, e.n, items, who, since, done, early, e.seq, e.worker, e.action, e.ms, e.item, list_position(items, e.item)::INT AS place, "
    "CASE WHEN e.action = 'next' THEN list_position(list_transform(items, lambda x, i: NOT done[i] AND (who[i] = '' OR who[i] = e.worker OR e.ms - since[i] >= 900)), true)::INT END AS pick FROM q JOIN e ON e.manifest = q.manifest AND e.n = q.n + 1)) "
    "SELECT manifest, seq, worker, items[pick] AS item FROM q WHERE action = 'next'"
)
def claim_queue(spark, d):
    """Items put in, handed out to workers and saved, a queue for each fifth of the users; a claim lives 900 seconds, which
    are 128 events here."""
    e = F.col("event_id")
    action = F.element_at(F.array(*(F.lit(x) for x in ("add", "next", "save", "next"))), (e % 4 + 1).cast("int"))
    item = F.when(e % 4 == 0, F.concat(F.lit("i"), e)).when(e % 4 == 2, F.concat(F.lit("i"), F.expr("event_id div 8 * 4")))
    r = events(spark, d).select((F.col("user_id") % 5).alias("manifest"), F.timestamp_seconds(e * 7).alias("ts"), e.alias("seq"), F.concat(F.lit("w"), F.expr("event_id div 7 % 6")).alias("worker"), action.alias("action"), item.alias("item"))
    return quota.run_to_table(stateful.claims(r, "manifest"), "claim_queue")


@query(
    "WITH n AS (SELECT count(*) AS total, sum(event_id)::DOUBLE AS ids FROM events), b AS (SELECT k, floor(total * (k + 1) / 4)::BIGINT AS done, total FROM n, (SELECT unnest(range(4)) AS k)) "
    "SELECT 'plan' AS type, 0::BIGINT AS done, total, NULL::DOUBLE AS ids FROM n UNION ALL SELECT 'progress', done, total, NULL FROM b UNION ALL SELECT 'done', total, total, ids FROM n"
)
def stream_progress(spark, d):
    """A stream over four files of equal size, followed from its plan to its end."""
    source, base = folder(spark, "progress-in"), folder(spark, "progress")
    e = t(spark, d, "events").select("event_id")
    total = e.count()
    placed = curate.running(e, {"place": F.lit(1)}, "event_id")
    part = F.least(F.call_function("div", F.col("place") * 4, F.lit(max(total, 1))), F.lit(3))
    for k in range(4):  # a file each, so that a micro-batch takes one
        placed.where(part == k).select("event_id").coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema("event_id bigint").option("maxFilesPerTrigger", 1).parquet(source)

    def start(df, name):
        return df.writeStream.queryName(name).format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    p = progress.followed(rows, "progress", {"ids": F.col("event_id")}, f"{base}/progress", start, total)
    return p.select("type", "done", "total", F.when(F.col("type") == "done", F.col("metrics")["ids"]).alias("ids"))
