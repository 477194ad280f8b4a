"""Nested columns: groups of frames, frame hashes, links between files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photonlake.functions import vectors
from photonlake.functions.hashes import normalized_hash, rounded
from photonlake.functions.vectors import seconds


def bound(value: Column, body) -> Column:
    """body(value) with the value worked out once: an expression that the body of a lambda names is worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stamps(groups: Column) -> Column:
    """Rounded time stamps of an array of groups."""
    return F.transform(groups, lambda g: seconds(g["timestamp_sec"]))


def frame_hashes(frames: Column) -> Column:
    """Frame hashes without invalid ones, with rounded times, by time and hash."""
    made = F.transform(frames, lambda f: F.struct(seconds(f["timestamp_sec"]).alias("timestamp_sec"), normalized_hash(f["phash_hex"]).alias("phash_hex")))
    return F.array_sort(F.filter(made, lambda f: f["phash_hex"].isNotNull()))


def hashes_by_stamp(frames: Column) -> Column:
    """Map from rounded time to hash; of equal times the last counts."""
    # They are sorted by time, so the next one tells whether a hash is the last of its time.
    next_at = lambda made, i: F.get(made, i + 1)["timestamp_sec"]
    return F.map_from_entries(bound(frame_hashes(frames), lambda made: F.filter(made, lambda f, i: ~f["timestamp_sec"].eqNullSafe(next_at(made, i)))))


def any_faces(groups: Column) -> Column:
    """Whether any group has a face vector; null for null."""
    return F.when(groups.isNotNull(), F.exists(groups, lambda g: F.coalesce(F.size(g["face_embeddings"]) > 0, F.lit(False))))


def polygons_present(polygons: Column) -> Column:
    return F.coalesce(F.size(polygons) > 0, F.lit(False))


def normal_links(links: Column) -> Column:
    """Links to files without blank names, the most similar one of each file (null counts least), similarity to three decimals, by similarity and name."""
    good = F.filter(links, lambda x: F.coalesce(F.trim(x["file_name"]) != "", F.lit(False)))
    made = F.transform(good, lambda x: F.struct(x["file_name"].alias("file_name"), F.coalesce(-rounded(x["similarity_pct"]), F.lit(1.0)).alias("k"), F.coalesce(x["is_video"], F.lit(False)).alias("is_video")))
    # By name first, so that the one before tells whether a link is the best of its file.
    best = bound(F.array_sort(made), lambda m: F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["file_name"] != x["file_name"])))
    order = F.array_sort(F.transform(best, lambda x: F.struct(x["k"].alias("k"), x["file_name"].alias("file_name"), x["is_video"].alias("is_video"))))
    return F.transform(order, lambda x: F.struct(x["file_name"].alias("file_name"), x["is_video"].alias("is_video"), F.when(x["k"] <= 0, F.abs(x["k"])).alias("similarity_pct")))


def distinct_lines(lines: Column) -> Column:
    """Lines joined by newlines; of lines that differ only by case the first stays, and blank ones go."""
    trimmed = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(trimmed, lambda x: F.lower(x))
    return F.concat_ws("\n", F.filter(trimmed, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1))


def spread(values: Column, most: int) -> Column:
    """At most `most` of an array, evenly spaced, with its first and last."""
    n = F.size(values)
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(most - 1, 1))).cast("int")))
    return F.when(n <= most, values).otherwise(F.transform(wanted, lambda i: F.get(values, i)))


def capped(groups: Column, most: int, field: str = "face_embeddings") -> Column:
    """Groups whose field keeps, over all groups in order, the first `most` elements."""
    size = lambda g: F.greatest(F.coalesce(F.size(g[field]), F.lit(0)), F.lit(0))

    # Only the first `most` groups that hold anything can keep something.
    def cut(held: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(held, F.lit(1), i), F.lit(0), lambda s, x: s + x["n"])
        return F.transform(held, lambda x, i: F.struct(x["at"].alias("at"), F.greatest(F.lit(most) - before(i), F.lit(0)).alias("left")))

    def kept(cuts: Column) -> Column:
        left = lambda i: F.when(i > F.coalesce(F.get(cuts, F.size(cuts) - 1)["at"], F.lit(-1)), 0).otherwise(F.coalesce(F.get(F.filter(cuts, lambda c: c["at"] == i), F.lit(0))["left"], F.lit(0)))
        return F.transform(groups, lambda g, i: g.withField(field, F.slice(g[field], F.lit(1), left(i))))

    places = F.filter(F.transform(groups, lambda g, i: F.struct(i.alias("at"), size(g).alias("n"))), lambda x: x["n"] > 0)
    return bound(bound(F.slice(places, 1, most), cut), kept)


def distinct_vectors(items: Column, field: str, least: float = 0.995) -> Column:
    """Items (an array of structs with a vector field) without those whose vector has at least this cosine with one kept before, in their order."""
    empty = F.slice(items, F.lit(1), F.lit(0))
    like = lambda kept, x: F.exists(kept, lambda y: vectors.cosine(y[field], x[field]) >= least)
    return F.aggregate(items, empty, lambda kept, x: F.when(like(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
