"""Cases of the text operators that earlier versions got wrong."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from photonlake.llm import simhash


def test_near_duplicates_go_by_fingerprints(spark, monkeypatch):
    """The pipeline's stage ties texts by SimHash before it holds their sets against each other: without such ties near copies stay."""
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(["new", *base[1:]])), (2, " ".join(f"x{k}" for k in range(120)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [0, 2]
    monkeypatch.setattr(simhash, "linked", lambda rows, *_: rows.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [0, 1, 2]


def test_long_fingerprints_of_similar_sets():
    """Sets of similarity 0.8, the smallest too, are within the radius; strangers are not."""
    rng = np.random.default_rng(5)
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(simhash.long_fingerprint(a), simhash.long_fingerprint(b)))
    for n in (5, 10, 55, 500) * 200:
        x, y = (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(2))
        assert apart(x, x[: -(n // 5)]) <= simhash.long_radius(0.8) < apart(x, y)
