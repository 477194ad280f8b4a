"""Frames nearest in time against every pair."""

import random
import time

from pyspark.sql import functions as F

from photonlake.operators import search

FRAMES, WANTED = "file_name string, timestamp_sec double, image_file string", "file_name string, seconds double"


def test_nearest_frame_against_brute_force(spark):
    rnd = random.Random(6)
    frames = [(f"f{rnd.randrange(12)}", rnd.randrange(20) / 2, f"i{n:03}") for n in range(150)] + [("f1", None, "x"), (None, 1.0, "y"), ("only", 4.0, None)]
    wanted = [(f"f{rnd.randrange(14)}", rnd.randrange(-4, 50) / 4) for _ in range(300)] + [("f1", None), (None, 1.0), ("only", 9.0), ("f2", 1.0), ("f2", 1.0)]
    want = {}
    for f, s in {w for w in wanted if None not in w}:
        near = [(abs(t - s), t, i or "") for x, t, i in frames if x == f and t is not None]
        if near:
            want[f, s] = min(near)[2] or None
    got = search.nearest_frame(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(wanted, WANTED)).collect()
    assert len(got) == len(want) and {(r.file_name, r.seconds): r.image_file for r in got} == want


def test_one_file_of_many_frames(spark):
    n = 300_000
    frames = spark.range(n).select(F.lit("one").alias("file_name"), (F.col("id") * 2.0).alias("timestamp_sec"), F.col("id").cast("string").alias("image_file"))
    wanted = spark.range(n).select(F.lit("one").alias("file_name"), (F.col("id") * 2.0 + 1.5).alias("seconds"))
    begun = time.time()
    got = search.nearest_frame(frames, wanted)
    wrong = got.filter(F.col("image_file").cast("long") != F.least((F.col("seconds") + 0.5) / 2, F.lit(n - 1)).cast("long")).count()
    assert wrong == 0 and got.count() == n and time.time() - begun < 60
