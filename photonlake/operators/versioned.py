"""Keyed tables in buckets, with numbered versions, checked patches and a journal.

A table is a folder: data/N-ID/bucket=B holds the rows that a change gave bucket B, versions/N.json says where each bucket is read from, journal/ID.json what a patch has done. A
change writes the buckets that it touches into a folder of its own and then its version file, which no one else may have written: so what is written follows the change, readers see one
version or the next, and of two writers that start from the same version the second is refused. The buckets of a version fit the driver (a name for each); rows never come there.
Folders that never became part of a version, as of a writer that was lost, are in no one's way; `vacuum` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photonlake.operators.tables import newest
from photonlake.plans.storage import kept

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Someone else has changed the table, or files that a plan relies on."""


@dataclass(frozen=True)
class Version:
    number: int
    key: str
    n: int
    schema: StructType
    buckets: dict[int, str]
    rows: int
    batch: int | None = None


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, value: dict, again: bool = False) -> None:
    """A small file as a whole: written beside its place and renamed, or, for one that must not be there yet, created there, which only one writer can."""
    at, fs = _fs(spark, path)
    data = json.dumps(value).encode()
    if not again:
        try:
            stream = fs.create(at, False)
        except Exception as e:
            raise Conflict(f"{path} is there already") from e
        stream.write(data)
        stream.close()
        return
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(data)
    stream.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} can't be written")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    at, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())


def versions(spark: SparkSession, table: str) -> list[int]:
    return _numbers(spark, f"{table}/versions")


def version(spark: SparkSession, table: str, number: int | None = None) -> Version:
    """A version of a table, the newest if no number is given."""
    if number is None:
        found = versions(spark, table)
        if not found:
            raise ValueError(f"{table} has no version yet")
        number = found[-1]
    v = _read(spark, f"{table}/versions/{number}.json")
    return Version(number, v["key"], v["n"], StructType.fromJson(v["schema"]), {int(b): x for b, x in v["buckets"].items()}, v["rows"], v.get("batch"))


def read(spark: SparkSession, table: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets; other buckets' files aren't looked at."""
    v = version(spark, table, number)
    places = [f"{table}/data/{x}/bucket={b}" for b, x in sorted(v.buckets.items()) if only is None or b in only]
    if not places:
        return spark.createDataFrame([], v.schema)
    return spark.read.schema(v.schema).parquet(*places)


def bucket(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64((F.col(key) if isinstance(key, str) else key).cast("string")), F.lit(n)).cast("int")


def _write(rows: DataFrame, table: str, number: int, key: str, n: int) -> tuple[str, list[int]]:
    """Write rows as buckets into a new folder: a task for each bucket. Returns its name and the buckets that have rows."""
    name = f"{number}-{uuid.uuid4().hex}"
    placed = rows.withColumn(BUCKET, bucket(key, n)).repartition(BUCKET)
    placed.withColumn("bucket", F.col(BUCKET)).drop(BUCKET).write.partitionBy("bucket").parquet(f"{table}/data/{name}")
    path, fs = _fs(rows.sparkSession, f"{table}/data/{name}")
    return name, sorted(int(s.getPath().getName()[7:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket="))


def _rows_of(spark: SparkSession, table: str, schema: StructType, buckets: dict[int, str]) -> DataFrame:
    places = [f"{table}/data/{x}/bucket={b}" for b, x in buckets.items()]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, table: str, number: int, key: str, n: int, schema: StructType, buckets: dict[int, str], batch: int | None) -> Version:
    rows = _rows_of(spark, table, schema, buckets).count()  # from the files' footers
    _create(spark, f"{table}/versions/{number}.json", {"key": key, "n": n, "schema": json.loads(schema.json()), "buckets": buckets, "rows": rows, "batch": batch})
    return version(spark, table, number)


def create(rows: DataFrame, table: str, key: str, n: int = 64) -> Version:
    """A new table with version 1. n: buckets, so many that the rows of one suit a task; it stays the same. Keys should be unique; null is a key like any other."""
    name, held = _write(rows, table, 1, key, n)
    return _commit(rows.sparkSession, table, 1, key, n, rows.schema, dict.fromkeys(held, name), None)


def _changed(spark: SparkSession, table: str, before: Version, new: Callable[[DataFrame], DataFrame], touched: list[int], batch: int | None, check: Callable[[DataFrame], None] = lambda df: None) -> Version:
    """The next version: `new` of the touched buckets' rows in their place. check sees the new rows before anything becomes a version; it raises to stop."""
    rows = new(read(spark, table, before.number, touched))
    name, held = _write(rows, table, before.number + 1, before.key, before.n)
    try:
        check(_rows_of(spark, table, rows.schema, dict.fromkeys(held, name)))
        if versions(spark, table)[-1] != before.number:
            raise Conflict(f"{table} is no longer at version {before.number}")
        buckets = {b: x for b, x in before.buckets.items() if b not in touched} | dict.fromkeys(held, name)
        return _commit(spark, table, before.number + 1, before.key, before.n, rows.schema, buckets, batch)
    except (Conflict, ValueError):
        at, fs = _fs(spark, f"{table}/data/{name}")
        fs.delete(at, True)
        raise


def upsert(batch: DataFrame, table: str, order: str, number: int | None = None) -> Version:
    """The newest row of each key out of the table and a batch, by the order column (see tables.newest), for the buckets that the batch touches. number: the batch's number in a stream; one that the table
    has had already changes nothing. A batch without rows makes no version."""
    spark, before = batch.sparkSession, version(batch.sparkSession, table)
    if number is not None and before.batch is not None and number <= before.batch:
        return before
    rows = kept(batch, "batch")
    touched = [r[0] for r in rows.select(bucket(before.key, before.n)).distinct().collect()]  # numbers of buckets
    if not touched:
        return before
    return _changed(spark, table, before, lambda old: newest(old, rows, before.key, order), touched, before.batch if number is None else number)


def delete(keys: DataFrame, table: str) -> Version:
    """The table without the rows of some keys; only the keys' buckets are written."""
    spark, before = keys.sparkSession, version(keys.sparkSession, table)
    gone = kept(keys.select(before.key).filter(F.col(before.key).isNotNull()).distinct(), "keys")
    touched = [r[0] for r in gone.select(bucket(before.key, before.n)).distinct().collect()]
    if not touched:
        return before
    return _changed(spark, table, before, lambda old: old.join(gone, before.key, "left_anti"), touched, before.batch)


def signatures(spark: SparkSession, paths: list[str]) -> dict[str, list[int] | None]:
    """Size and time of change of each of a plan's few files; none for one that isn't there."""
    out: dict[str, list[int] | None] = {}
    for p in paths:
        at, fs = _fs(spark, p)
        status = fs.getFileStatus(at) if fs.exists(at) else None
        out[p] = [status.getLen(), status.getModificationTime()] if status else None
    return out


def plan(spark: SparkSession, table: str, patch: DataFrame, files: list[str] = []) -> dict:
    """What a patch (rows with the key and the columns to set) is planned on: the table's version and the signatures of files that must stay as they are. The patch is kept beside it."""
    v, rows = version(spark, table), kept(patch, "patch")
    unknown = [c for c in rows.columns if c not in v.schema.names]
    if unknown or v.key not in rows.columns:
        raise ValueError(f"a patch has the key {v.key} and columns of the table, not {unknown}")
    n, keys = rows.agg(F.count(F.lit(1)), F.count_distinct(v.key)).first()
    if n != keys:
        raise ValueError("a patch has one row for each key, and no null key")
    return {"table": table, "version": v.number, "rows": v.rows, "patched": n, "patch": rows, "signatures": signatures(spark, files)}


def apply(spark: SparkSession, planned: dict, journal: str, valid: Callable[[DataFrame], Column] | None = None, fail: Callable[[str], None] = lambda at: None) -> Version:
    """Apply a planned patch as the table's next version, or change nothing.

    Refused (Conflict) if the table isn't at the planned version, or a file's signature isn't the planned one. The patch must update exactly its rows: a key that the table lacks, more or fewer
    rows than before, or rows for which `valid` isn't true, are a ValueError, and no version appears. journal: the name of this run's record, which must be new: `recover` undoes a run that didn't
    end. fail: called between the steps, for tests.
    """
    table, before = planned["table"], version(spark, planned["table"])
    record = f"{table}/journal/{journal}.json"
    if before.number != planned["version"]:
        raise Conflict(f"{table} is at version {before.number}, the plan is for {planned['version']}")
    if signatures(spark, list(planned["signatures"])) != planned["signatures"]:
        raise Conflict("files that the plan relies on have changed")
    _create(spark, record, {"status": "applying", "from": before.number, "to": before.number + 1})
    fail("recorded")
    patch, key = planned["patch"], before.key
    touched = [r[0] for r in patch.select(bucket(key, before.n)).distinct().collect()]
    values = [c for c in patch.columns if c != key]
    new = patch.select(key, F.struct(*values).alias("__new") if values else F.struct(F.lit(1)).alias("__new"))

    def patched(old: DataFrame) -> DataFrame:
        both = old.join(new, key, "left")
        return both.select(*(F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).cast(before.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns))

    def check(rows: DataFrame) -> None:
        old = read(spark, table, before.number, touched)
        if old.join(new, key, "left_semi").count() != planned["patched"]:
            raise ValueError("the patch wouldn't update exactly its rows")
        if rows.count() != old.count():
            raise ValueError("the patch would add or remove rows")
        if valid is not None and rows.filter(~F.coalesce(valid(rows), F.lit(False))).limit(1).count():
            raise ValueError("rows aren't valid after the patch")
        fail("checked")

    try:
        if not touched:
            made = before
        else:
            made = _changed(spark, table, before, patched, touched, before.batch, check)
        fail("committed")
    except (Conflict, ValueError) as e:
        _create(spark, record, {"status": "refused", "from": before.number, "to": before.number, "error": str(e)}, again=True)
        raise
    _create(spark, record, {"status": "complete", "from": before.number, "to": made.number}, again=True)
    return made


def recover(spark: SparkSession, table: str) -> list[str]:
    """Undo runs whose journal says that they didn't end: a version that such a run made is followed by one with the buckets of before, if no one else has changed the table since (Conflict
    otherwise: that needs a person). Returns the journals undone."""
    at, fs = _fs(spark, f"{table}/journal")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []
    undone = []
    for name in names:
        record = _read(spark, f"{table}/journal/{name}")
        if record["status"] != "applying":
            continue
        head = version(spark, table)
        if head.number > record["to"]:
            raise Conflict(f"{table} has changed since {name}")
        if head.number == record["to"]:
            old = version(spark, table, record["from"])
            value = {"key": old.key, "n": old.n, "schema": json.loads(old.schema.json()), "buckets": old.buckets, "rows": old.rows, "batch": old.batch}
            _create(spark, f"{table}/versions/{head.number + 1}.json", value)
        _create(spark, f"{table}/journal/{name}", record | {"status": "undone"}, again=True)
        undone.append(name[:-5])
    return undone


def _folders(spark: SparkSession, table: str) -> dict[str, list]:
    """The folders of a table's data, with their buckets' places."""
    at, fs = _fs(spark, f"{table}/data")
    return {s.getPath().getName(): [x.getPath() for x in fs.listStatus(s.getPath()) if x.getPath().getName().startswith("bucket=")] for s in fs.listStatus(at)}


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Remove all versions but the last few, and the buckets that none of those reads. Folders of the version that comes next stay: someone may be writing them."""
    found = versions(spark, table)
    used = {(x, b) for v in found[-keep:] for b, x in version(spark, table, v).buckets.items()}
    for x in found[:-keep]:
        at, fs = _fs(spark, f"{table}/versions/{x}.json")
        fs.delete(at, False)
    for name, places in _folders(spark, table).items():
        gone = [p for p in places if (name, int(p.getName()[7:])) not in used]
        if int(name.split("-")[0]) > found[-1]:
            continue
        for p in gone if len(gone) < len(places) else [_fs(spark, f"{table}/data/{name}")[0]]:
            _, fs = _fs(spark, table)
            fs.delete(p, True)


def written(spark: SparkSession, table: str, number: int) -> tuple[int, int]:
    """Buckets and bytes that a version wrote."""
    mine = [(b, x) for b, x in version(spark, table, number).buckets.items() if x.startswith(f"{number}-")]
    _, fs = _fs(spark, table)
    return len(mine), sum(fs.getContentSummary(_fs(spark, f"{table}/data/{x}/bucket={b}")[0]).getLength() for b, x in mine)
