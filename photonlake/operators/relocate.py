"""Moving a collection: keys are mapped one to many or many to one, and every reference follows.

A mapping has old_key, new_key, chat (where the new file is), size and mtime_ns. Of several new keys for a reference, one of the same
chat as the row that refers is taken, else the first by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions.paths import rewritten_id


def targets(mapping: DataFrame) -> DataFrame:
    """Rows (old_key, first): the reference's target without a context."""
    return mapping.groupBy("old_key").agg(F.min("new_key").alias("first"))


def fan_out(rows: DataFrame, mapping: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """A row for each new key, with the new file's size and time; rows without a mapping stay, but for dropped keys (file_name). Adds old_key, chat and mapped."""
    if drop is not None:
        rows = rows.join(drop.select("file_name").distinct(), "file_name", "left_anti")
    m = mapping.select(F.col("old_key").alias("__old"), "new_key", "chat", F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"))
    out = rows.join(m, rows.file_name == F.col("__old"), "left")
    new = {"file_name": F.coalesce("new_key", "file_name")}
    if "source_size" in rows.columns:
        new["source_size"] = F.when(F.col("new_key").isNotNull(), F.col("__size")).otherwise(F.col("source_size"))
    if "source_mtime_ns" in rows.columns:
        new["source_mtime_ns"] = F.when(F.col("new_key").isNotNull(), F.col("__mtime")).otherwise(F.col("source_mtime_ns"))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], F.col("file_name").alias("old_key"), "chat", F.col("new_key").isNotNull().alias("mapped"))


def referred(rows: DataFrame, mapping: DataFrame, column: str, drop: DataFrame | None = None) -> DataFrame:
    """rows (with chat) whose references in a column follow the mapping; references to dropped keys become null."""
    first = targets(mapping).select(F.col("old_key").alias("__ref"), "first")
    near = mapping.groupBy(F.col("old_key").alias("__ref"), F.col("chat").alias("__chat")).agg(F.min("new_key").alias("near"))
    out = rows.join(first, F.col(column) == F.col("__ref"), "left").drop("__ref")
    out = out.join(near, (F.col(column) == F.col("__ref")) & F.col("chat").eqNullSafe(F.col("__chat")), "left").drop("__ref", "__chat")
    value = F.coalesce("near", "first", column)
    if drop is not None:
        gone = drop.select(F.col("file_name").alias("__gone")).distinct()
        out = out.join(gone, F.col(column) == F.col("__gone"), "left")
        value = F.when(F.col("__gone").isNull(), value)
    return out.withColumn(column, value).drop("near", "first", "__gone")


def referred_links(rows: DataFrame, mapping: DataFrame, column: str = "cross_media_matches", drop: DataFrame | None = None) -> DataFrame:
    """rows (file_name, column) whose arrays of links follow the mapping: a link becomes one for each new key, equal links count once, links to dropped keys and to oneself go."""
    flat = rows.select("file_name", F.posexplode(column).alias("i", "x"))
    if drop is not None:
        flat = flat.join(drop.select(F.col("file_name").alias("__gone")).distinct(), F.col("x.file_name") == F.col("__gone"), "left_anti")
    m = mapping.select(F.col("old_key").alias("__old"), "new_key")
    moved = flat.join(m, F.col("x.file_name") == F.col("__old"), "left").withColumn("x", F.col("x").withField("file_name", F.coalesce("new_key", "x.file_name"))).filter("x.file_name <> file_name")
    lists = moved.groupBy("file_name").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("x.file_name").alias("n"), "x"))), lambda s: s["x"])).alias("__links"))
    empty = F.array().cast(dict((f.name, f.dataType) for f in rows.schema.fields)[column])
    return rows.join(lists, "file_name", "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("__links", empty))).drop("__links")


def path_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """A side table's rows (id, file_name, ...) under each new key, with their ids."""
    m = mapping.select(F.col("old_key").alias("__old"), "new_key")
    out = rows.join(m, F.col("file_name") == F.col("__old"), "left")
    new = F.coalesce("new_key", "file_name")
    names = {"id": rewritten_id(F.col("id"), F.col("file_name"), new), "file_name": new}
    return out.select(*[names.get(c, F.col(c)).alias(c) for c in rows.columns])


def opaque_clones(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows that can't be cloned: mapped to several keys, under an id that doesn't name the old one."""
    many = mapping.groupBy(F.col("old_key").alias("file_name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = (F.col("id") == F.col("file_name")) | F.col("id").startswith(F.concat("file_name", F.lit("|")))
    return rows.join(many, "file_name").filter(~own).select("id", "file_name")


def collisions(mapping: DataFrame) -> DataFrame:
    """New keys that several old ones go to: new_key, sources."""
    return mapping.groupBy("new_key").agg(F.count_distinct("old_key").alias("sources")).filter("sources > 1")


def inventory(index: DataFrame, mapping: DataFrame, excluded: DataFrame, collection: str) -> DataFrame:
    """One row of counts: rows of the collection, mapped, unmapped, excluded, missing (mapped keys without a row), repeated keys and collisions."""
    own = index.filter(F.col("collection_id") == collection).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    m = mapping.select(F.col("old_key").alias("file_name")).distinct().withColumn("m", F.lit(True))
    x = excluded.select("file_name").distinct().withColumn("x", F.lit(True))
    whole = own.join(m, "file_name", "full").join(x, "file_name", "left")
    there, is_m, is_x = F.col("n").isNotNull(), F.coalesce("m", F.lit(False)), F.coalesce("x", F.lit(False))
    counts = whole.agg(
        F.count_if(there).alias("keys"), F.count_if(there & is_m).alias("mapped"), F.count_if(there & ~is_m & ~is_x).alias("unmapped"), F.count_if(there & is_x).alias("excluded"),
        F.count_if(~there & is_m).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"),
    )
    return counts.join(collisions(mapping).agg(F.count(F.lit(1)).alias("collisions")), F.lit(True))


# Columns that are one observation, and are taken together or not at all.
SIFT = ("sift_match_file", "sift_match_score", "sift_match_inliers", "sift_match_good_matches", "sift_match_inlier_ratio", "sift_match_checked")
FAMILIES = (("dedupe_match_file", "dedupe_similarity_pct"), SIFT, ("skip_processing", "processing_error_stage", "processing_error"), ("image_width", "image_height"))


def coalesced(rows: DataFrame, target: str = "file_name", order: str = "old_key", primary: str | None = None, families: tuple[tuple[str, ...], ...] = FAMILIES, strict: bool = True) -> DataFrame:
    """One row for each target, out of the rows that move to it.

    The row of the target's primary source (`primary` names a boolean column) is the base, else the first by `order`. A column that is null there takes the others' value if they
    agree on one; a family takes its columns together, from the first row that has any of them, if all are null in the base and no column of it differs. Where set values of any column
    differ, the base must be the one primary row (or several equal ones): without it the merge is an error, or with strict=False a row with resolved = false.
    Adds merged (rows that went into it), conflict (some column had different values) and resolved.
    """
    names = [c for c in rows.columns if c not in (target, order, primary)]
    chosen = F.coalesce(F.col(primary), F.lit(False)) if primary else F.lit(False)
    whole = F.struct(*names)
    own = [[c for c in f if c in names] for f in families]
    own = [f for f in own if f]
    single = [c for c in names if not any(c in f for f in own)]
    aggs = [F.min_by(whole, order).alias("__first"), F.min_by(F.when(chosen, whole), F.when(chosen, F.col(order))).alias("__primary")]
    aggs += [(~F.min(F.when(chosen, whole)).eqNullSafe(F.max(F.when(chosen, whole)))).alias("__several")]
    aggs += [F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"__differs_{c}") for c in names] + [F.min(c).alias(f"__any_{c}") for c in single]
    for k, f in enumerate(own):
        present = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in f])
        aggs.append(F.min_by(F.when(present, F.struct(*f)), F.when(present, F.col(order))).alias(f"__donor{k}"))
    made = rows.groupBy(target).agg(F.count(F.lit(1)).alias("merged"), *aggs)
    conflict = F.greatest(*[F.col(f"__differs_{c}") for c in names]) if len(names) > 1 else F.col(f"__differs_{names[0]}")
    resolved = ~conflict | (F.col("__primary").isNotNull() & ~F.col("__several"))
    made = made.withColumn("conflict", conflict).withColumn("resolved", resolved).withColumn("__base", F.coalesce("__primary", "__first"))
    if strict:
        said = F.concat(F.lit("values of one target differ without one primary source: "), F.col(target).cast("string"))
        made = made.withColumn("resolved", F.when(F.col("resolved"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
    out = {c: F.coalesce(F.col(f"__base.{c}"), F.when(~F.col(f"__differs_{c}"), F.col(f"__any_{c}"))) for c in single}
    for k, f in enumerate(own):
        empty, agreed = F.lit(True), F.lit(True)
        for c in f:
            empty, agreed = empty & F.col(f"__base.{c}").isNull(), agreed & ~F.col(f"__differs_{c}")
        out |= {c: F.when(empty & agreed, F.col(f"__donor{k}.{c}")).otherwise(F.col(f"__base.{c}")) for c in f}
    return made.select(target, *[out[c].alias(c) for c in names], "merged", "conflict", "resolved")


def without_self(rows: DataFrame) -> DataFrame:
    """References of a row to itself, with their figures, become null, and its links to itself go."""
    own = lambda c: F.col(c) == F.col("file_name")
    for ref, figures in (("dedupe_match_file", ("dedupe_similarity_pct",)), ("sift_match_file", SIFT[1:5])):
        if ref in rows.columns:
            at = F.coalesce(own(ref), F.lit(False))
            rows = rows.withColumns({c: F.when(~at, F.col(c)) for c in figures if c in rows.columns}).withColumn(ref, F.when(~at, F.col(ref)))
    if "cross_media_matches" in rows.columns:
        rows = rows.withColumn("cross_media_matches", F.filter("cross_media_matches", lambda x: ~x["file_name"].eqNullSafe(F.col("file_name"))))
    return rows


def variants(rows: DataFrame, payload: list[str]) -> DataFrame:
    """A side table's rows one for each id and payload: where payloads of one id differ, the id gets |variant: and the payload's SHA-256."""
    keyed = rows.withColumn("__p", F.sha2(F.to_json(F.struct(*payload)).cast("binary"), 256)).dropDuplicates(["file_name", "id", "__p"])
    n = F.count(F.lit(1)).over(Window.partitionBy("file_name", "id"))
    return keyed.withColumn("__n", n).withColumn("id", F.when(F.col("__n") > 1, F.concat("id", F.lit("|variant:"), "__p")).otherwise(F.col("id"))).drop("__p", "__n")


def moved_roots(roots: DataFrame, collection: str, path: str) -> DataFrame:
    """Roots with the collection's path replaced, or added."""
    there = roots.select("collection_id", F.when(F.col("collection_id") == collection, F.lit(path)).otherwise(F.col("root_path")).alias("root_path"))
    new = roots.sparkSession.createDataFrame([(collection, path)], "collection_id string, root_path string")
    return there.unionByName(new.join(roots.select("collection_id"), "collection_id", "left_anti"))


def ledger(mapping: DataFrame, missing: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows (old_key, new_key, status) for every file: present, missing or excluded."""
    none = F.lit(None).cast("string").alias("new_key")
    return (
        mapping.select("old_key", "new_key", F.lit("present").alias("status"))
        .unionByName(missing.select(F.col("file_name").alias("old_key"), none, F.lit("missing").alias("status")))
        .unionByName(excluded.select(F.col("file_name").alias("old_key"), none, F.lit("excluded").alias("status")))
    )


def faults(output: DataFrame, mapping: DataFrame, source_rows: Column | int, dropped: int, coalesced_: int) -> DataFrame:
    """Rows (check, faults) about a moved table: repeated keys, references that still name an old key, new keys without a row, and rows that are not accounted for."""
    repeated = output.groupBy("file_name").count().filter("count > 1").agg(F.count(F.lit(1)).alias("faults")).select(F.lit("repeated keys").alias("check"), "faults")
    gone = mapping.select("old_key").distinct().join(mapping.select(F.col("new_key").alias("old_key")).distinct(), "old_key", "left_anti")
    refs = output.select(F.explode(F.array("file_name", "dedupe_match_file", "sift_match_file")).alias("old_key"))
    stale = refs.join(gone, "old_key", "left_semi").agg(F.count(F.lit(1)).alias("faults")).select(F.lit("stale references").alias("check"), "faults")
    uncovered = mapping.select(F.col("new_key").alias("file_name")).distinct().join(output, "file_name", "left_anti").agg(F.count(F.lit(1)).alias("faults")).select(F.lit("uncovered targets").alias("check"), "faults")
    cloned = mapping.groupBy("old_key").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cloned"))
    balance = output.agg(F.count(F.lit(1)).alias("rows")).join(cloned, F.lit(True)).select(F.lit("conservation").alias("check"), F.abs(F.col("rows") - (F.lit(source_rows) - dropped + F.col("cloned") - coalesced_)).alias("faults"))
    return repeated.unionByName(stale).unionByName(uncovered).unionByName(balance)


def inventory_rows(index: DataFrame, listing: DataFrame, collection: str) -> DataFrame:
    """Rows (file_name, there, size, mtime_ns) of a collection: each key once, with what the listing (file_name, size, mtime_ns) says of its file."""
    own = index.filter(F.col("collection_id") == collection).select("file_name").distinct()
    seen = listing.select("file_name", "size", "mtime_ns", F.lit(True).alias("t"))
    return own.join(seen, "file_name", "left").select("file_name", F.coalesce("t", F.lit(False)).alias("there"), "size", "mtime_ns")


def unmapped(index: DataFrame, mapping: DataFrame, excluded: DataFrame, collection: str) -> DataFrame:
    """Keys (file_name) of a collection that are neither mapped nor excluded."""
    own = index.filter(F.col("collection_id") == collection).select("file_name").distinct()
    return own.join(mapping.select(F.col("old_key").alias("file_name")), "file_name", "left_anti").join(excluded.select("file_name"), "file_name", "left_anti")


def changes(before: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, change) where two snapshots of a table differ: added, removed or changed in one of the columns. Without any the snapshot still holds. Keys are unique."""
    facts = F.struct(*columns)
    both = before.select(key, facts.alias("__a")).join(now.select(key, facts.alias("__b")), key, "full")
    what = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.select(key, what.alias("change")).filter("change IS NOT NULL")


def repair_candidates(keys: DataFrame, files: DataFrame, collection: str, by: str | None = None) -> DataFrame:
    """Mapping (old_key, new_key) of keys to files that moved into a range folder: the one file of equal chat, tail and size, if there is just one and no
    key has its name yet. keys: file_name, size; files: path (relative to the collection), size. Folders named p at the top are left out. Keys are unique, or
    are told apart by a further column, `by`, which is then returned too."""
    own = ["file_name", *([by] if by else [])]
    rel = lambda c: F.substr(F.col(c), F.instr(c, "/") + 1)
    split = keys.withColumn("rel", rel("file_name")).withColumn("chat", F.substring_index("rel", "/", 1)).withColumn("tail", rel("rel"))
    parts = F.split("path", "/")
    ranged = files.filter((F.size(parts) >= 3) & F.get(parts, F.lit(1)).rlike(r"^\d{4}-\d{2}-\d{2}T[^/]+__") & (F.lower(F.get(parts, F.lit(0))) != "p"))
    ranged = ranged.select(F.concat(F.lit(collection + "/"), "path").alias("new_key"), F.get(parts, F.lit(0)).alias("chat"), F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/").alias("tail"), "size")
    met = split.join(ranged, ["chat", "tail", "size"]).groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("new_key").alias("new_key")).filter("n = 1")
    free = met.join(keys.select(F.col("file_name").alias("new_key")), "new_key", "left_anti")
    alone = free.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("new_key"))).filter("m = 1")
    return alone.select(F.col("file_name").alias("old_key"), "new_key", *own[1:])
