"""Signals, media containers, array files and the shuffle against numpy, the wave module and plain loops."""

import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import signal
from corvane.operators import curate
from corvane.sources import media, npy

C = F.col


def plain_prepared(samples, rate, channels):
    x = np.array(samples[: len(samples) // channels * channels], float).reshape(-1, channels).mean(1)
    if rate != 16000 and len(x):
        x = x[np.clip((np.arange(int(len(x) * 16000 / rate)) * rate / 16000).astype(int), 0, len(x) - 1)]
    return np.concatenate([np.zeros(160), x, np.zeros(160)]).tolist()


def test_signals_equal_index_arithmetic(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(n)], rate, channels) for i, (n, rate, channels) in enumerate((n, r, c) for n in (0, 1, 7, 300) for r in (8000, 11025, 16000, 44100, 48000) for c in (1, 2, 3))]
    df = spark.createDataFrame(rows, "i int, s array<double>, rate int, ch int")
    got = {r.i: r.x for r in df.select("i", signal.prepared(C("s"), C("rate"), C("ch"), seconds=0.01).alias("x")).collect()}
    for i, s, rate, channels in rows:
        assert got[i] == pytest.approx(plain_prepared(s, rate, channels)), (i, rate, channels)
    assert df.select(signal.prepared(F.lit(None).cast("array<double>"), 8000).alias("x")).first().x is None


def container(path, n, rate, channels, width):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes(n * channels * width))
    return path.read_bytes()


def test_probed_files(spark, tmp_path):
    want = {}
    for i, (n, rate, channels, width) in enumerate([(1600, 16000, 1, 2), (4410, 44100, 2, 2), (0, 8000, 1, 1), (777, 48000, 1, 3)]):
        container(tmp_path / f"{i}.wav", n, rate, channels, width)
        want[f"{i}.wav"] = (n / rate, {1: "pcm_u8", 2: "pcm_s16le", 3: "pcm_s24le"}[width], str(rate), str(channels), True)
    good = (tmp_path / "0.wav").read_bytes()
    tag = lambda name, n: name + n.to_bytes(4, "little") + b"x" * (n + n % 2)
    (tmp_path / "tagged.wav").write_bytes(good[:12] + tag(b"LIST", 33_333) + good[12:36] + tag(b"junk", 9001) + tag(b"bext", 1) + good[36:])
    want["tagged.wav"] = (0.1, "pcm_s16le", "16000", "1", True)
    (tmp_path / "cut.wav").write_bytes(good[:1644])
    want["cut.wav"] = (800 / 16000, "pcm_s16le", "16000", "1", True)
    (tmp_path / "late.wav").write_bytes(good[:12] + good[36:])  # samples without a format
    extensible = b"fmt " + (40).to_bytes(4, "little") + (0xFFFE).to_bytes(2, "little") + good[22:36] + bytes(8) + (3).to_bytes(2, "little") + bytes(14)
    extensible = extensible[:22] + (32).to_bytes(2, "little") + extensible[24:]
    (tmp_path / "float.wav").write_bytes(good[:12] + extensible + good[36:])
    want["float.wav"] = (0.1, "pcm_f32le", "16000", "1", True)
    for name, content in (("text.wav", b"not a container at all"), ("head.wav", good[:20]), ("zero.wav", good[:28] + bytes(4) + good[32:])):
        (tmp_path / name).write_bytes(content)
    for name in ("late.wav", "text.wav", "head.wav", "zero.wav"):
        want[name] = (0.0, None, None, None, False)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.wav")
    for head in (64, media.HEAD):
        got = {r.path.rsplit("/", 1)[1]: (r.duration, r.codec, r.sr, r.ch, r.ok) for r in media.probed(files, head=head).collect()}
        assert got == {k: (pytest.approx(v[0]), *v[1:]) for k, v in want.items()}
    none = media.probed(spark.createDataFrame([("x", None), ("empty", b"")], "path string, content binary")).collect()
    assert [(r.duration, r.ok) for r in none] == [(0.0, False)] * 2 and media.probed(files.limit(0)).count() == 0


def test_array_files(spark, tmp_path):
    spark.dataSource.register(npy.ArrayFiles)
    rng = np.random.default_rng(1)
    arrays = {"a": rng.normal(size=(10, 6)).astype("<f4"), "b": np.asfortranarray(rng.normal(size=(7, 6))), "c": rng.integers(-9, 9, (5, 6)).astype(">i2"), "d": np.zeros((0, 6)), "e": np.zeros((3, 6), bool)}
    for name, x in arrays.items():
        np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / "note.txt").write_text("no array")
    got = spark.read.format("npy").option("rows", 3).load(f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() == 4 + 3 + 2 + 1
    seen = {(r.path.rsplit("/", 1)[1][0], r.row): r["values"] for r in got.collect()}
    assert seen == {(name, i): row for name, x in arrays.items() for i, row in enumerate(x.astype(float).tolist())}
    some = spark.read.format("npy").option("columns", "5,0-1").load(f"file://{tmp_path}/b.npy").orderBy("row").collect()
    assert [r["values"] for r in some] == arrays["b"][:, [5, 0, 1]].tolist()
    for bad in (np.zeros(3), np.zeros((2, 2), complex), np.array([["x"]])):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(Exception, match="bad.npy"):
            spark.read.format("npy").load(f"file://{tmp_path}/bad.npy").count()
    (tmp_path / "bad.npy").write_bytes(b"\x93NUMPY\x01")
    with pytest.raises(Exception, match="bad.npy"):
        spark.read.format("npy").load(f"file://{tmp_path}/bad.npy").count()


def test_array_files_are_written_whole(spark, tmp_path):
    spark.dataSource.register(npy.ArrayFiles)
    df = spark.range(1000).select(F.array(C("id").cast("double"), F.sqrt("id")).alias("values")).repartition(5)
    df.write.format("npy").mode("append").save(f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 5 and all(f.suffix == ".npy" for f in files)
    rows = np.concatenate([np.load(f) for f in files])
    assert sorted(rows[:, 0]) == list(range(1000)) and (rows[:, 1] == np.sqrt(rows[:, 0])).all()
    df.limit(10).write.format("npy").mode("overwrite").save(f"file://{tmp_path}/out")
    assert spark.read.format("npy").load(f"file://{tmp_path}/out").count() == 10


def test_shuffles_are_permutations(spark):
    sizes = [1, 2, 3, 5, 7, 16, 17, 31, 100, 257, 1000, 4097]
    for n in sizes:
        got = [r.shuffled for r in curate.shuffled(spark.range(n), "id", n).orderBy("id").collect()]
        assert sorted(got) == list(range(n)), n
        assert n < 100 or sum(a == i for i, a in enumerate(got)) < 12
    other = [r.shuffled for r in curate.shuffled(spark.range(4097), "id", 4097, seed=8).orderBy("id").collect()]
    assert sum(a == b for a, b in zip(got, other)) < 20
    moved = np.corrcoef(np.arange(4097), got)[0, 1]
    assert abs(moved) < 0.1
    far = spark.range(1).select(curate.shuffled_place(F.lit(10**15 - 1), 10**15).alias("x")).first().x
    assert 0 <= far < 10**15
