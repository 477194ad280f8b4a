"""Paths and file names. A file name in a table is collection/relative/path with forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by kind; the indexer's sets and the viewer's differ.
INDEXED_IMAGES = ["bmp", "heic", "heif", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
INDEXED_VIDEOS = ["avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "webm", "wmv"]
VIEWED = ["avi", "avif", "bmp", "gif", "heic", "heif", "icns", "ico", "jpeg", "jpg", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "png", "svg", "tiff", "webm", "webp", "wmv"]
THUMBNAIL_FOLDERS = ("thumb", "thumbs", "thumbnails")


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, empty without one; a leading dot is part of the name."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_video(path: Column) -> Column:
    return extension(path).isin(INDEXED_VIDEOS)


def is_image(path: Column) -> Column:
    return extension(path).isin(INDEXED_IMAGES)


def collection_of(file_name: Column) -> Column:
    """What stands before the first slash; null without one."""
    return F.when(F.instr(file_name, "/") > 0, F.substring_index(file_name, "/", 1))


def relative_of(file_name: Column) -> Column:
    """What stands after the first slash; null without one."""
    at = F.instr(file_name, "/")
    return F.when(at > 0, F.substr(file_name, at + 1))


def normal_key(path: Column) -> Column:
    """A path as a key: forward slashes, without ./ and slashes at its start or slashes at its end."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(?:\\./)+", ""), "^/+|/+$", "")


def match_path(path: Column) -> Column:
    """A path for comparing: forward slashes, lower case, no slash at the end."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""))


def components(path: Column) -> Column:
    """Components that aren't empty."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def is_thumbnail(path: Column) -> Column:
    """Whether the name holds thumb or a folder is one of thumbnails."""
    parts = F.split(F.lower(path), "/")
    return F.contains(F.lower(basename(path)), F.lit("thumb")) | F.arrays_overlap(parts, F.array(*map(F.lit, THUMBNAIL_FOLDERS)))


def is_safe_relative(path: Column) -> Column:
    """Not blank, not absolute and without a .. component."""
    return F.coalesce((F.trim(path) != "") & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda x: x == ".."), F.lit(False))


def default_collection(root: Column) -> Column:
    """Collection id of a folder: its cleaned name, @ and 12 digits of the path's SHA-1."""
    return F.concat(F.regexp_replace(basename(root), "[^A-Za-z0-9._-]+", "_"), F.lit("@"), F.substring(F.sha1(root.cast("binary")), 1, 12))


def row_id(file_name: Column, seconds: Column, *more: Column) -> Column:
    """file|seconds with three decimals, and what follows."""
    return F.concat_ws("|", file_name, F.format_string("%.3f", seconds.cast("double")), *(x.cast("string") for x in more))


def rewritten_id(identifier: Column, old: Column, new: Column) -> Column:
    """An id that is the old key, or starts with it and a bar, under the new key; any other as it is."""
    inside = identifier.startswith(F.concat(old, F.lit("|")))
    return F.when(identifier == old, new).when(inside, F.concat(new, F.substr(identifier, F.length(old) + 1))).otherwise(identifier)


def decoded_uri(raw: Column) -> Column:
    """A file URI's path with its percent escapes decoded; a plus stays a plus, and a broken escape leaves the whole as it is."""
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def bytes_apart(a: Column, b: Column, most: int) -> Column:
    """Edit distance over UTF-8 bytes, or null if it is over `most`."""
    one = lambda x: F.decode(F.encode(x, "utf-8"), "iso-8859-1")
    d = F.levenshtein(one(a), one(b), most)
    return F.when(d >= 0, d)


def component_matches(query: Column, candidate: Column) -> Column:
    """One contains the other, or their edit distance is at most 2 (queries of 12 bytes or more) or 1 (5 or more)."""
    n = F.octet_length(query)
    return (
        F.contains(candidate, query)
        | F.contains(query, candidate)
        | ((n >= 12) & bytes_apart(query, candidate, 2).isNotNull())
        | ((n >= 5) & bytes_apart(query, candidate, 1).isNotNull())
    )


def partly_matches(query: Column, candidate: Column) -> Column:
    """The candidate contains the query, or some of its components in a row match the query's one by one. Both in lower case."""
    q, c = components(query), components(candidate)
    k, n = F.size(q), F.size(c)
    windows = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
    places = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    fits = F.exists(windows, lambda i: F.forall(places, lambda j: F.coalesce(component_matches(F.get(q, j - 1), F.get(c, i + j - 1)), F.lit(False))))
    return F.contains(candidate, query) | ((k > 0) & (k <= n) & fits)


def name_matches(query: str, path: Column, *others: Column) -> Column:
    """File-name search. Without a slash: the name contains the query. With one: some form of the path matches in part; if the query's last
    component has a dot, the name must equal it. Case doesn't count."""
    query = query.strip().lower()
    if "/" not in query:
        return F.contains(F.lower(basename(path)), F.lit(query))
    forms = [F.lower(F.replace(x, F.lit("\\"), F.lit("/"))) for x in (path, *others)]
    found = F.lit(False)
    for x in forms:
        found = found | F.coalesce(partly_matches(F.lit(query), x), F.lit(False))
    last = query.rsplit("/", 1)[1]
    return found & (F.lower(basename(path)) == last) if "." in last else found


def in_folder(file_name: Column, source_path: Column, folder: str) -> Column:
    """Folder scope. Blank: all. A plain word: contained in a folder's name, not in the collection's or the file's. A path: the file name equals it, begins
    with it or contains it as whole folders, or the source path equals it or lies below. source_path may be null."""
    wanted = folder.strip().replace("\\", "/").lower().rstrip("/")
    if not wanted:
        return F.lit(True)
    name, source = (F.lower(F.replace(x, F.lit("\\"), F.lit("/"))) for x in (file_name, source_path))
    if "/" not in wanted:
        parts, below = F.split(name, "/"), F.split(source, "/")
        own = F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: F.contains(s, F.lit(wanted)))
        real = F.exists(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), lambda s: F.contains(s, F.lit(wanted)))
        return own | F.coalesce(real, F.lit(False))
    inner = wanted.strip("/")
    own = (name == inner) | name.startswith(inner + "/") | F.contains(name, F.lit(f"/{inner}/"))
    return own | F.coalesce((source == wanted) | source.startswith(wanted + "/"), F.lit(False))
