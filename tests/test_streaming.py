"""Streams give what their batch versions give."""

import random

import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import sequence
from corvane.streaming import quota, stateful


def stream(spark, df, folder, files=3):
    df.repartition(files).write.mode("overwrite").parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def test_quota_matches_batch(spark, tmp_path):
    rows = [("k", f"2024-01-01 0{i // 6}:0{i % 6}:00", i) for i in range(11)] + [("k", "2024-01-02 00:00:00", 11), ("z", "2024-01-01 00:00:00", 12)]
    df = spark.createDataFrame(rows, "k string, ts string, e bigint").withColumn("ts", F.to_timestamp("ts"))
    got = quota.run_to_table(stateful.quota(stream(spark, df, tmp_path / "q"), "k", "ts", "e", 10, "3 days"), "quota_test")
    want = sequence.running_quota(df, "k", "ts", "e", 10)
    assert {(r.k, r.event, r.allowed, r.remaining) for r in got.collect()} == {(r.k, r.e, r.allowed, r.remaining) for r in want.collect()}
    last = got.where("event = 10").first()
    assert not last.allowed and last.remaining == 0


def test_quota_orders_a_group_across_chunks(spark, tmp_path):
    rows = [("k", 1_704_067_200 + (i * 37) % 101 // 2, i) for i in range(101)] + [("z", 1_704_067_200 - i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").select("k", F.timestamp_seconds("s").alias("ts"), "e")
    want = {(r.k, r.e, r.rn, r.allowed, r.remaining) for r in sequence.running_quota(df, "k", "ts", "e", 10).withColumnRenamed("nth", "rn").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = quota.run_to_table(stateful.quota(stream(spark, df, tmp_path / "q"), "k", "ts", "e", 10, "3 days"), "quota_chunks").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.event, r.nth, r.allowed, r.remaining) for r in got} == want and len(got) == 104


def test_quota_goes_on_and_drops_closed_days(spark, tmp_path):
    folder, base = tmp_path / "in", f"file://{tmp_path}/base"
    schema = "k string, at bigint, e bigint"
    day = 86_400

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).parquet(str(folder)).withColumn("ts", F.timestamp_seconds("at"))
        got = quota.run_to_table(stateful.quota(source, "k", "ts", "e", 2, "1 hour"), "quota_runs", base=base)
        return {(r.k, str(r.day), r.event): (r.nth, r.allowed, r.remaining) for r in got.collect()}

    a = run([("k", 10 * day + 50, 2), ("k", 10 * day + 50, 1), ("k", 10 * day + 50, None), (None, 10 * day + 1, 5)])
    assert a == {("k", "1970-01-11", 1): (1, True, 1), ("k", "1970-01-11", 2): (2, True, 0), ("k", "1970-01-11", None): (3, False, 0), (None, "1970-01-11", 5): (1, True, 1)}
    b = run([("k", 10 * day + 60, 9), ("k", 11 * day + 9, 1)])
    assert b == a | {("k", "1970-01-11", 9): (4, False, 0), ("k", "1970-01-12", 1): (1, True, 1)}
    run([("z", 13 * day, 1)])  # the watermark passes both days
    c = run([("k", 10 * day + 70, 3), ("k", 13 * day + 5, 4)])
    assert ("k", "1970-01-11", 3) not in c and c["k", "1970-01-14", 4] == (1, True, 1)


def test_claims_expire_and_are_offered_again(spark, tmp_path):
    acts = [(0, "", "add", "a"), (0, "", "add", "b"), (10, "x", "next", None), (20, "y", "next", None), (30, "x", "next", None), (40, "z", "next", None), (50, "x", "save", "a"), (1000, "z", "next", None), (1001, "y", "next", None)]
    rows = [("m", i, t, w, a, it) for i, (t, w, a, it) in enumerate(acts)]
    df = spark.createDataFrame(rows, "m string, seq bigint, t bigint, worker string, action string, item string").withColumn("ts", F.timestamp_seconds("t"))
    got = quota.run_to_table(stateful.claims(stream(spark, df.coalesce(1), tmp_path / "c", 1), "m"), "claims_test")
    assert {r.seq: r.item for r in got.collect()} == {2: "a", 3: "b", 4: "a", 5: None, 7: "b", 8: None}


def test_partials_match_batch(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, "a b c d"), ("s", 1, "a b c d e"), ("s", 2, "q r c d e f")], "s string, i bigint, t string")
    got = quota.run_to_table(quota.partial_commit(stream(spark, df, tmp_path / "p", 1), "s", "i", "t"), "partials_test").orderBy("seq").collect()
    assert [r.locked for r in got] == [["a"], ["a", "b"], ["a", "b", "c"]]


def test_sessions_and_statistics(spark, tmp_path):
    ev = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 05:00:00"), ("v", "2024-01-03 00:00:00")], "u string, ts string").withColumn("ts", F.to_timestamp("ts"))
    s = quota.run_to_table(quota.session_windows(stream(spark, ev, tmp_path / "s", 1), "u", "ts"), "sessions_test", "append")
    assert {(r.u, r.n) for r in s.collect()} == {("u", 2), ("u", 1)}
    st = quota.run_to_table(quota.session_statistics(stream(spark, ev, tmp_path / "t", 1), "u", "ts"), "stats_test", "complete")
    assert {(r.u, r.n) for r in st.collect()} == {("u", 3), ("v", 1)}


def test_exact_counts_of_keys_over_batches(spark, tmp_path):
    rows = [("a", i % 7, "x") for i in range(40)] + [(None, 1, "x"), ("b", None, "x"), ("b", 3, "x")]
    df = spark.createDataFrame(rows, "kind string, k int, key string")
    folder, base = tmp_path / "in", f"file://{tmp_path}/base"
    total = lambda t: {r.kind: (r.n, r.keys) for r in t.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys")).collect()}
    source = stream(spark, df, folder, 3).select("kind", "k")
    assert total(quota.run_to_table(stateful.session_counts(source, "kind", "k", buckets=3), "counts_test", base=base)) == {"a": (40, 7), None: (1, 1), "b": (2, 1)}
    spark.createDataFrame([("a", 3, "x"), ("a", 99, "x")], df.schema).write.mode("append").parquet(str(folder))
    assert total(quota.run_to_table(stateful.session_counts(source, "kind", "k", buckets=3), "counts_test", base=base))["a"] == (42, 8)


def plain_claims(requests, ttl):
    items, held, done, out = [], {}, set(), {}
    for at, seq, worker, action, item in sorted(requests):
        if action == "add" and item not in items:
            items.append(item)
        elif action == "save":
            done.add(item)
            held.pop(item, None)
        elif action == "next":
            able = (i for i in items if i not in done and not (i in held and held[i][0] != worker and at - held[i][1] < ttl))
            out[seq] = pick = next(able, None)
            if pick is not None:
                held[pick] = (worker, at)
    return out


def test_claims_equal_a_plain_queue_over_batches(spark, tmp_path):
    rng = random.Random(3)
    kinds = {"a": [], "b": []}
    for seq in range(300):
        action = rng.choice(["add", "next", "next", "save"])
        item = f"i{rng.randrange(40)}" if action != "next" else None
        kinds[rng.choice("ab")].append((seq * 20 + rng.randrange(15), seq, f"w{rng.randrange(4)}", action, item))
    folder, base = tmp_path / "in", f"file://{tmp_path}/base"
    schema = "m string, at bigint, seq bigint, worker string, action string, item string"
    for part in range(3):  # three runs of one queue, each from its checkpoint
        rows = [(m, *r) for m, rs in kinds.items() for r in rs if part * 100 <= r[1] < part * 100 + 100]
        spark.createDataFrame(rows, schema).repartition(2).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).parquet(str(folder)).withColumn("ts", F.timestamp_seconds("at"))
        got = quota.run_to_table(stateful.claims(source, "m", ttl_seconds=100), "claims_runs", base=base)
    want = {(m, seq): item for m, rs in kinds.items() for seq, item in plain_claims(rs, 100).items()}
    rows = got.collect()
    assert {(r.m, r.seq): r.item for r in rows} == want and len(rows) == len(want)


def test_segments_time_out_and_go_on_after_a_restart(spark, tmp_path):
    folder, base = tmp_path / "in", f"file://{tmp_path}/base"
    schema = "s string, at bigint, i bigint, d double"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).parquet(str(folder)).withColumn("ts", F.timestamp_seconds(F.col("at") + 1000))
        got = quota.run_to_table(stateful.bounded_segments(source, "s", "ts", "i", "d", idle="30 seconds", delay="5 seconds"), "segments_runs", base=base)
        return sorted((r.s, r.segment, r.first, r["last"], r.seconds, r.flushed) for r in got.collect())

    first = [("s", 2 * i, i, 4.0) for i in range(7)] + [("t", 0, 0, 1.0), ("t", 40, 1, 2.0), ("u", 41, 0, None)]
    a = run(first)
    # of s one chunk is left, of t the first chunk timed out before the second came; timers need the watermark
    assert a == [("s", 0, 0, 2, 12.0, "full"), ("s", 1, 3, 5, 12.0, "full"), ("t", 0, 0, 0, 1.0, "idle")]
    b = run([("v", 60, 0, 1.0), ("s", 39, 7, 7.0)])
    assert b == sorted([*a, ("s", 2, 6, 7, 11.0, "full")])
    c = run([("v", 200, 1, 1.0)])
    assert c == sorted([*b, ("t", 1, 1, 1, 2.0, "idle"), ("u", 0, 0, 0, 0.0, "idle"), ("v", 0, 0, 0, 1.0, "idle")])


def test_ordered_rows_spill_and_merge():
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(20)]), i) for i in range(500)]
    chunks = (pd.DataFrame(rows[i : i + 37], columns=["k", "i"]).astype(object) for i in range(0, 500, 37))
    got = list(stateful.ordered(chunks, ["k", "i"], run=60))
    assert [(None if k is None or k != k else k, i) for k, i in got] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_a_failing_stream_reports_its_failure(spark, tmp_path):
    from corvane.streaming import progress

    df = spark.createDataFrame([(i,) for i in range(10)], "x int")
    rows = stream(spark, df, tmp_path / "in", 2).select(F.when(F.col("x") < 9, F.col("x")).otherwise(F.raise_error(F.lit("nine")).cast("int")).alias("x"))
    start = lambda d, name: d.writeStream.queryName(name).format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    try:
        progress.followed(rows, "bad", {}, f"file://{tmp_path}/progress", start)
        raise AssertionError("no failure")
    except Exception as e:
        assert "nine" in str(e)
    import time

    for _ in range(50):
        told = [r.type for r in spark.read.schema(progress.SCHEMA).parquet(f"file://{tmp_path}/progress").collect()] if (tmp_path / "progress").exists() else []
        if told[:1] == ["plan"]:
            break
        time.sleep(0.2)
    assert "plan" in told and "done" not in told


def test_a_stage_waits_for_a_complete_table(spark, tmp_path):
    from corvane.sources import sinks

    (tmp_path / "t").mkdir()  # begun, not complete
    try:
        sinks.when_there(spark, f"file://{tmp_path}/t", poll=0.05, timeout=0.2)
        raise AssertionError("taken too early")
    except TimeoutError:
        pass
    spark.range(3).write.mode("overwrite").parquet(f"file://{tmp_path}/t")
    assert sinks.when_there(spark, f"file://{tmp_path}/t", timeout=1.0).count() == 3
