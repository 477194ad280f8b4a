"""Bucketed tables: what a change writes, late and repeated batches, versions, patches with planted faults, and recovery."""

import uuid

import pytest
from pyspark.sql import functions as F

from photonlake.operators import versioned
from photonlake.plans.storage import shared_dir

SCHEMA = "k string, seq long, v string"


@pytest.fixture
def table(spark):
    path = f"{shared_dir(spark)}/versioned-{uuid.uuid4().hex}"
    versioned.create(spark.createDataFrame([(f"k{i}", 10, f"old{i}") for i in range(400)] + [(None, 10, "no key")], SCHEMA), path, "k", 16)
    return path


def rows(spark, table, number=None):
    return {r.k: (r.seq, r.v) for r in versioned.read(spark, table, number).collect()}


def test_upsert_writes_only_its_buckets(spark, table):
    before = rows(spark, table)
    whole = versioned.written(spark, table, 1)
    assert whole[0] == 16 and versioned.version(spark, table).rows == 401
    made = versioned.upsert(spark.createDataFrame([("k5", 11, "new"), ("k5", 12, "newer"), ("k6", 9, "late"), ("other", 1, "first")], SCHEMA), table, "seq")
    assert rows(spark, table) == before | {"k5": (12, "newer"), "other": (1, "first")}
    assert made.number == 2 and made.rows == 402
    buckets, size = versioned.written(spark, table, 2)
    assert buckets <= 3 and size < whole[1] / 3
    assert rows(spark, table, 1) == before
    assert versioned.upsert(spark.createDataFrame([], SCHEMA), table, "seq").number == 2


def test_numbered_batches_and_new_columns(spark, table):
    batch = spark.createDataFrame([("k1", 20, "x", 5)], SCHEMA + ", more int")
    assert versioned.upsert(batch, table, "seq", 7).number == 2
    assert versioned.upsert(batch, table, "seq", 7).number == 2 and versioned.upsert(batch, table, "seq", 3).number == 2
    got = {r.k: r.more for r in versioned.read(spark, table).collect()}
    assert got["k1"] == 5 and got["k2"] is None and len(got) == 401


def test_delete(spark, table):
    made = versioned.delete(spark.createDataFrame([("k1",), ("k2",), (None,), ("nowhere",)], "k string"), table)
    assert made.rows == 399 and not {"k1", "k2"} & set(rows(spark, table)) and None in rows(spark, table)
    assert versioned.written(spark, table, 2)[0] <= 3


def test_two_writers_from_one_version(spark, table):
    before = versioned.version(spark, table)
    versioned.upsert(spark.createDataFrame([("k1", 99, "first")], SCHEMA), table, "seq")
    with pytest.raises(versioned.Conflict):
        versioned._changed(spark, table, before, lambda old: old, [0], None)
    assert versioned.versions(spark, table) == [1, 2] and rows(spark, table)["k1"] == (99, "first")


def patch(spark, *keys):
    return spark.createDataFrame([(k, "patched") for k in keys], "k string, v string")


def test_patch(spark, table):
    before = rows(spark, table)
    planned = versioned.plan(spark, table, patch(spark, "k3", "k4"))
    made = versioned.apply(spark, planned, "one", lambda df: F.col("v").isNotNull())
    assert rows(spark, table) == before | {"k3": (10, "patched"), "k4": (10, "patched")} and made.rows == 401
    assert versioned._read(spark, f"{table}/journal/one.json")["status"] == "complete" and versioned.recover(spark, table) == []
    with pytest.raises(versioned.Conflict):  # planned on version 1
        versioned.apply(spark, planned, "two")
    with pytest.raises(versioned.Conflict):  # a journal is never written over
        versioned.apply(spark, versioned.plan(spark, table, patch(spark, "k3")), "one")
    assert versioned.versions(spark, table) == [1, 2]


def test_patches_that_are_refused(spark, table):
    before = rows(spark, table)
    for name, keys, valid in (("missing", ("k3", "nowhere"), None), ("invalid", ("k3",), lambda df: F.col("v") != "patched")):
        with pytest.raises(ValueError):
            versioned.apply(spark, versioned.plan(spark, table, patch(spark, *keys)), name, valid)
        assert versioned._read(spark, f"{table}/journal/{name}.json")["status"] == "refused"
    for bad in (patch(spark, "k1", "k1"), patch(spark, "k1", None), patch(spark, "k1").withColumnRenamed("v", "unknown")):
        with pytest.raises(ValueError):
            versioned.plan(spark, table, bad)
    assert rows(spark, table) == before and versioned.versions(spark, table) == [1]


def test_patch_is_refused_if_files_changed(spark, table, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("content")
    planned = versioned.plan(spark, table, patch(spark, "k3"), [f"file://{tmp_path}/a", f"file://{tmp_path}/gone"])
    (tmp_path / "b").write_text("other")
    versioned.apply(spark, planned, "fine")
    planned = versioned.plan(spark, table, patch(spark, "k3"), [f"file://{tmp_path}/a"])
    (tmp_path / "a").write_text("longer content")
    with pytest.raises(versioned.Conflict, match="files"):
        versioned.apply(spark, planned, "changed")


@pytest.mark.parametrize("at", ["recorded", "checked", "committed"])
def test_an_interrupted_patch_is_undone(spark, table, at):
    before = rows(spark, table)

    def stop(step):
        if step == at:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versioned.apply(spark, versioned.plan(spark, table, patch(spark, "k3", "k9")), "broken", fail=stop)
    assert versioned.recover(spark, table) == ["broken"]
    assert rows(spark, table) == before and versioned.recover(spark, table) == []
    versioned.apply(spark, versioned.plan(spark, table, patch(spark, "k3")), "again")
    assert rows(spark, table)["k3"] == (10, "patched")


def test_a_change_after_an_interrupted_patch_needs_a_person(spark, table):
    def stop(step):
        if step == "committed":
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versioned.apply(spark, versioned.plan(spark, table, patch(spark, "k3")), "broken", fail=stop)
    versioned.upsert(spark.createDataFrame([("k1", 99, "x")], SCHEMA), table, "seq")
    with pytest.raises(versioned.Conflict):
        versioned.recover(spark, table)


def test_vacuum(spark, table):
    for i in range(4):
        versioned.upsert(spark.createDataFrame([(f"k{i}", 50 + i, "x")], SCHEMA), table, "seq")
    before = rows(spark, table)
    versioned.vacuum(spark, table)
    assert versioned.versions(spark, table) == [4, 5] and rows(spark, table) == before and len(rows(spark, table, 4)) == 401
    versioned.upsert(spark.createDataFrame([("k9", 90, "y")], SCHEMA), table, "seq")
    assert rows(spark, table) == before | {"k9": (90, "y")}


def test_a_lost_writer_is_in_no_ones_way(spark, table, monkeypatch):
    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versioned, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            versioned.upsert(spark.createDataFrame([("k1", 98, "lost")], SCHEMA), table, "seq", 1)
    assert versioned.versions(spark, table) == [1] and len(versioned._folders(spark, table)) == 2
    versioned.upsert(spark.createDataFrame([("k1", 99, "again")], SCHEMA), table, "seq", 1)
    assert rows(spark, table)["k1"] == (99, "again")
    versioned.vacuum(spark, table)
    assert len(versioned._folders(spark, table)) == 2 and rows(spark, table)["k1"] == (99, "again")
