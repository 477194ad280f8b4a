"""Keyed tables on plain Parquet: upsert, deletion, schema changes, side tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonlake.functions import groups, paths, vectors


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an explicit order."""
    names = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in names])


def upserted(table: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """table with the batch's rows in place of those of the same key; of a batch's rows with one key the last counts."""
    new = last_of_each(batch, key, order)
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new, allowMissingColumns=True)


def newest(table: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest order, out of a table and a batch, both with the order column, which stays: so a row that comes late loses to a newer one
    that is there already. Of rows of equal order the batch's counts; a null order is lowest. Columns that only one of them has are null in the other's rows."""
    both = table.withColumn("__side", F.lit(0)).unionByName(batch.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c not in (key, "__side")]
    best = F.max_by(F.struct(*names), F.struct(order, "__side")).alias("r")
    return both.groupBy(key).agg(best).select(key, *[F.col(f"r.{c}").alias(c) for c in names])


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows of these keys; rows without a key stay."""
    return table.join(keys.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def conformed(table: DataFrame, schema: T.StructType) -> DataFrame:
    """table with a schema's columns and types: missing ones are null, other ones go, and values that can't be cast are null."""
    have = {f.name: f.dataType for f in table.schema.fields}

    def column(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        kind = f.dataType.simpleString()
        return (F.col(f.name) if have[f.name] == f.dataType else F.expr(f"try_cast(`{f.name}` AS {kind})")).alias(f.name)

    return table.select(*map(column, schema.fields))


def grouped_legacy(table: DataFrame) -> DataFrame:
    """Old single values (face_embeddings, clip_embedding, text_detected and text) as one group at time 0 where there are no groups."""
    zero = F.lit(0.0).cast("float").alias("timestamp_sec")
    made = {
        "face_groups": ("face_embeddings", lambda: F.struct(zero, F.col("face_embeddings"))),
        "clip_groups": ("clip_embedding", lambda: F.struct(zero, F.col("clip_embedding"))),
        "ocr_groups": ("text_detected", lambda: F.struct(zero, F.col("text_detected"), F.col("text"))),
    }
    for name, (old, group) in made.items():
        if old in table.columns:
            new = F.when(F.col(old).isNotNull(), F.array(group()))
            table = table.withColumn(name, F.coalesce(F.col(name), new) if name in table.columns else new)
    return table.drop("face_embeddings", "clip_embedding", "text_detected", "text")


def renamed_keys(table: DataFrame, collection: str) -> DataFrame:
    """Keys without a collection get it in front, in file_name, in links and in the array of links."""
    prefix = lambda c: F.when(c.isNull() | c.startswith(collection + "/"), c).otherwise(F.concat(F.lit(collection + "/"), c))
    out = table
    for c in ("file_name", "dedupe_match_file", "sift_match_file"):
        if c in table.columns:
            out = out.withColumn(c, prefix(F.col(c)))
    if "cross_media_matches" in table.columns:
        out = out.withColumn("cross_media_matches", F.transform("cross_media_matches", lambda x: x.withField("file_name", prefix(x["file_name"]))))
    return out


def face_rows(index: DataFrame, dim: int = 512) -> DataFrame:
    """One row for each face vector of the right size: id, file_name, timestamp_sec, face_index, vector."""
    frames = index.select("file_name", F.explode("face_groups").alias("g"))
    faces = frames.select("file_name", vectors.seconds(F.col("g.timestamp_sec")).alias("timestamp_sec"), F.posexplode("g.face_embeddings").alias("face_index", "v"))
    rows = faces.withColumn("vector", vectors.safe(F.col("v"), dim)).filter("vector IS NOT NULL")
    return rows.select(paths.row_id(F.col("file_name"), F.col("timestamp_sec"), F.col("face_index")).alias("id"), "file_name", "timestamp_sec", "face_index", "vector")


def usual_dim(rows: DataFrame, column: str = "vector") -> int:
    """The size that most vectors have (the larger of two as frequent); 0 without vectors."""
    top = rows.filter(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return top.d if top else 0


def clip_rows(index: DataFrame, dim: int | None = None) -> DataFrame:
    """One row for each frame's vector: id, file_name, timestamp_sec, vector. dim: the table's, else the usual one."""
    rows = index.select("file_name", F.explode("clip_groups").alias("g")).select("file_name", vectors.seconds(F.col("g.timestamp_sec")).alias("timestamp_sec"), F.col("g.clip_embedding").alias("v"))
    dim = dim or usual_dim(rows, "v")
    rows = rows.withColumn("vector", vectors.safe(F.col("v"), dim)).filter("vector IS NOT NULL")
    return rows.select(paths.row_id(F.col("file_name"), F.col("timestamp_sec")).alias("id"), "file_name", "timestamp_sec", "vector")


def text_rows(index: DataFrame) -> DataFrame:
    """One row for each frame with text: id, file_name, timestamp_sec, text."""
    rows = index.select("file_name", F.explode("ocr_groups").alias("g")).select("file_name", vectors.seconds(F.col("g.timestamp_sec")).alias("timestamp_sec"), F.trim("g.text").alias("text"), "g.text_detected").filter("text_detected AND text <> ''")
    return rows.select(paths.row_id(F.col("file_name"), F.col("timestamp_sec")).alias("id"), "file_name", "timestamp_sec", "text")


def synced(side: DataFrame, rebuilt: DataFrame, changed: DataFrame) -> DataFrame:
    """A side table after a run: the rows of changed files are those that were rebuilt, the others stay."""
    return without(side, changed, "file_name").unionByName(rebuilt.join(changed.select("file_name").distinct(), "file_name", "left_semi").select(*side.columns))


def missing_tables(index: DataFrame, there: DataFrame, base: str = "base") -> DataFrame:
    """Rows (name): the side tables that have to be made for each table of the index, which the column `base` names; that of texts only if it has any.
    there: name, the tables that exist."""
    with_text = index.groupBy(base).agg(F.max(any_text()).alias("text"))
    kinds = F.array_compact(F.array(F.lit("_face_ann"), F.lit("_clip_ann"), F.when(F.col("text"), F.lit("_ocr_ann"))))
    wanted = with_text.select(base, F.explode(kinds).alias("kind")).select(F.concat(base, "kind").alias("name"))
    return wanted.join(there.select("name").distinct(), "name", "left_anti")


def present_only(index: DataFrame, listing: DataFrame, collection: str) -> DataFrame:
    """index without the rows of a collection whose file isn't in the listing (file_name); rows of other collections stay, whatever is listed."""
    own = F.coalesce(F.col("collection_id") == collection, F.lit(False))
    listed = listing.select("file_name", F.lit(True).alias("__listed")).distinct()
    return index.join(listed, "file_name", "left").filter(~own | F.col("__listed").isNotNull()).select(*index.columns)


def tables_sorted(layouts: DataFrame) -> DataFrame:
    """Rows (name, columns, types) of what sorted tables were sorted by (name, place, column, type): what stands for captured indexes. A rebuilt table is valid if its row is equal."""
    by = F.transform(F.array_sort(F.collect_list(F.struct("place", "column", "type"))), lambda x: x)
    rows = layouts.groupBy("name").agg(by.alias("by"))
    return rows.select("name", F.col("by.column").alias("columns"), F.col("by.type").alias("types"))


def index_faults(captured: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows (name, fault) of layouts (see tables_sorted) that aren't the same after a rebuild: missing, unexpected, other columns or other types."""
    old, new = (x.select("name", F.col("columns").alias(f"c{k}"), F.col("types").alias(f"t{k}")) for k, x in enumerate((captured, rebuilt)))
    fault = F.when(F.col("c1").isNull(), "missing").when(F.col("c0").isNull(), "unexpected").when(F.col("c0") != F.col("c1"), "columns").when(F.col("t0") != F.col("t1"), "types")
    return old.join(new, "name", "full").select("name", fault.alias("fault")).filter("fault IS NOT NULL")


def any_text():
    """Whether a row has a frame with text."""
    return F.coalesce(F.exists("ocr_groups", lambda g: F.coalesce(g["text_detected"], F.lit(False)) & (F.trim(F.coalesce(g["text"], F.lit(""))) != "")), F.lit(False))


def newest_status(status: DataFrame) -> DataFrame:
    """The newest status of each collection."""
    names = [c for c in status.columns if c not in ("collection_id", "updated")]
    return status.groupBy("collection_id").agg(F.max("updated").alias("updated"), F.max_by(F.struct(*names), F.struct("updated", *names)).alias("s")).select("collection_id", "updated", "s.*")


def normal_index(index: DataFrame) -> DataFrame:
    """An index as readers see it: valid hashes, sorted frames, normal links."""
    from photonlake.functions.hashes import normalized_hash

    return index.withColumn("phash_hex", normalized_hash(F.col("phash_hex"))).withColumn("video_frame_phashes", groups.frame_hashes(F.col("video_frame_phashes"))).withColumn("cross_media_matches", groups.normal_links(F.col("cross_media_matches")))


def write_sorted(table: DataFrame, path: str, key: str) -> None:
    """Write a table in ranges of its key, sorted within files: lookups by key read few of them."""
    table.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)


def publish(table: DataFrame, path: str, check: Callable[[DataFrame], bool] = lambda df: True) -> None:
    """Write a table beside its place, check it, and put it there by renaming; the one before goes once the new one stands. Raises ValueError
    if the check fails, and then leaves everything as it was."""
    spark = table.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.partial-{uuid.uuid4().hex}", f"{path}.before-{uuid.uuid4().hex}"
    place, fresh, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = place.getFileSystem(conf)
    table.write.parquet(new)
    if not check(spark.read.parquet(new)):
        fs.delete(fresh, True)
        raise ValueError("the new table failed its check")
    if fs.exists(place) and not fs.rename(place, gone):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(fresh, place):
        fs.rename(gone, place)
        raise OSError(f"{new} can't be moved")
    fs.delete(gone, True)
