"""The text index against the scan of all frames."""

import random
import uuid

from pyspark.sql import functions as F

from photonlake.operators import search, text_index
from photonlake.plans.storage import shared_dir


def test_index_equals_the_scan(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta", "Gamma", "straße", "été", "zz", "a", "line\nbreak", "x.y", "delta-force", "\U0001f600smile"]
    rows = [(f"d{i % 5}/f{i // 3}.{'mp4' if i % 4 == 0 else 'jpg'}", i % 4 == 0, float(i % 3), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))).lower() if i % 11 else None) for i in range(300)]
    rows += [("rare.jpg", False, 0.0, "only here: needle in hay"), ("rare2.jpg", False, 0.0, "needle")]
    frames = spark.createDataFrame(rows, "file_name string, is_video boolean, timestamp_sec double, text_lower string")
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    text_index.build(frames, path, blocks=16, folders=4)
    read = {}
    for q in ("needle", '"needle in"', "Needle alpha", "STRASSE straße", "a", '"alpha beta"', '"line\nbreak"', "nothing", "", "delta-force \U0001f600sm"):
        for more in ({}, {"video_only": True}, {"min_score": 0.6}, {"folder": "d3"}):
            want = sorted(map(tuple, search.search_text(frames, q, **more).collect()))
            assert sorted(map(tuple, text_index.search_index(spark, path, q, **more).collect())) == want, (q, more)
            if q not in ("needle", "a", "nothing"):
                break
        read[q] = text_index.blocks_for(spark, path, q)
    assert len(read["needle"][0]) <= 2 and len(read['"needle in"'][0]) == 1 and read["nothing"] == ([], 16) and read[""] == ([], 16) and len(read["a"][0]) == 16
