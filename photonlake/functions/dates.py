"""Dates of media files. Times are seconds since 1970 in the session's time zone, which should be pinned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats in file names, in the order in which they are tried, with the digits' pattern of each.
NAME_FORMATS = (
    (r"\d{2}-\d{2}-\d{4}_\d{2}-\d{2}-\d{2}", "dd-MM-yyyy_HH-mm-ss"),
    (r"\d{8}_\d{6}", "yyyyMMdd_HHmmss"),
    (r"\d{8}-\d{6}", "yyyyMMdd-HHmmss"),
    (r"\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}", "yyyy-MM-dd_HH-mm-ss"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}", "yyyy-MM-dd'T'HH-mm-ss"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
)


def whole_seconds(ns: Column) -> Column:
    """Nanoseconds to seconds, rounded down."""
    return F.floor((ns - F.pmod(ns, F.lit(1_000_000_000))) / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def capture_time(path: Column) -> Column:
    """The first date in a file name: formats in their order, each at every place from the left; null if none is a date."""
    name = stem(path)

    def tried(digits: str, form: str) -> Column:
        found = F.regexp_extract_all(name, F.lit(f"(?=({digits}))"), F.lit(1))
        times = F.transform(found, lambda x: F.unix_seconds(F.try_to_timestamp(x, F.lit(form))))
        return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))

    return F.coalesce(*[tried(*f) for f in NAME_FORMATS])


def exif_time(value: Column) -> Column:
    """Time of an EXIF date (yyyy:MM:dd HH:mm:ss, the first 19 characters, NULs at the ends are cut)."""
    return F.unix_seconds(F.try_to_timestamp(F.substring(F.regexp_replace(value, "^\\x00+|\\x00+$", ""), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")))


def taken(original: Column, digitized: Column, changed: Column) -> Column:
    """EXIF time: original, else digitized, else changed."""
    return F.coalesce(exif_time(original), exif_time(digitized), exif_time(changed))


def earlier(a: Column, b: Column) -> Column:
    """The smaller of two times, or the one there is."""
    return F.least(a, b)


def effective(modified: Column, exif: Column, path: Column, video: Column) -> Column:
    """The earlier of the file's time and its capture time (from EXIF, which videos don't have, or its name)."""
    return earlier(modified, F.coalesce(F.when(~F.coalesce(video, F.lit(False)), exif), capture_time(path)))
