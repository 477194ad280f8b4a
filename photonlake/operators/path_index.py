"""An index for file-name search: which paths can match a query, before the exact rule looks at them.

A path matches a query with slashes if, in one of its forms, some components in a row match the query's one by one: one contains the other, or they are one or two bytes apart (functions.paths). So
it has a component that matches the query's longest one. Distinct components are few beside paths, and are found by

* their trigrams, if they contain the query's component;
* their whole, if they are a part of it: a query has few substrings;
* pieces, if they are nearly equal: of three pieces of a component two bytes away (two of one a byte away) one is whole, and no further than that from its place.

Components lead to paths, and the rule itself decides. Tables are cut into folders by hashes of what is looked for, and a search reads only its folders.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions import paths

#: Bytes of a gram.
GRAM = 3
#: Bytes of a query's component from which on one, and two, bytes may differ (as in paths.component_matches).
ONE_OFF, TWO_OFF = 5, 12


def _key(kind: str, data: bytes) -> int:
    """The hash of something to look for, as a signed long; the same as _hashed of it."""
    return (x := xxhash.xxh64_intdigest(kind.encode() + data, seed=42)) - (x >> 63 << 64)


def _hashed(kind: str | Column, data: Column) -> Column:
    """xxhash64 of a kind and bytes that stand in an ISO-8859-1 string, sign by sign."""
    return F.xxhash64(F.encode(F.concat(F.lit(kind) if isinstance(kind, str) else kind, data), "iso-8859-1"))


def _bytes(text: Column) -> Column:
    """A string with a sign for each byte of the text in UTF-8."""
    return F.decode(F.encode(text, "utf-8"), "iso-8859-1")


def _edges(n: int, parts: int) -> list[int]:
    return [i * n // parts for i in range(parts + 1)]


def _pieces(text: Column, parts: int) -> list[Column]:
    """Hashes of a text's pieces, told apart by how many there are, its length and their number."""
    n = F.length(text)
    edges = [F.floor(n * i / parts).cast("int") for i in range(parts + 1)]
    return [_hashed(F.concat(F.lit(f"{parts}/{i}/"), n.cast("string"), F.lit(":")), F.substring(text, edges[i] + 1, edges[i + 1] - edges[i])) for i in range(parts)]


def forms(rows: DataFrame, *columns: str) -> Column:
    """The forms of a path that are searched, in lower case and with slashes: physical, by its key, relative, joined with its root; those that are there."""
    return F.array_compact(F.array(*[F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/"))) for c in columns]))


def build(rows: DataFrame, path: str, physical: str, *others: str, folders: int = 256) -> None:
    """Write the index of rows (with a column `key`, one row each): path/rows has them with their forms, path/components what components are looked for by, path/places which rows have them, path/folders how many folders
    these are cut into. Rows without a key or a physical path can't be found."""
    known = rows.filter(F.col("key").isNotNull() & F.col(physical).isNotNull()).withColumn("forms", forms(rows, physical, *others))
    name = F.lower(paths.basename(F.col(physical)))
    parts = F.array_distinct(F.concat(F.array(name), F.flatten(F.transform("forms", paths.components))))
    placed = known.select("key", F.explode(parts).alias("component")).filter("component <> ''").withColumn("hash", _hashed("=", _bytes(F.col("component"))))
    text = _bytes(F.col("component"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: _hashed("g", F.substr(text, i, F.lit(GRAM))))
    looked = F.array_distinct(F.concat(F.array("hash", *_pieces(text, 2), *_pieces(text, 3)), grams))
    folder = lambda c: F.pmod(F.col(c), F.lit(folders)).cast("int")
    distinct = placed.select("component", "hash").distinct()
    known.write.parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(folders,)], "n int").coalesce(1).write.parquet(f"{path}/folders")
    for name_, table, by in (("components", distinct.select(F.explode(looked).alias("look"), "component", "hash"), "look"), ("places", placed.select("hash", "key"), "hash")):
        table.withColumn("folder", folder(by)).repartition("folder", F.pmod(F.xxhash64("hash"), F.lit(4))).sortWithinPartitions("folder", by).write.partitionBy("folder").parquet(f"{path}/{name_}")


COMPONENTS, PLACES = "look long, component string, hash long, folder int", "hash long, key {}, folder int"


def _folders(spark: SparkSession, path: str) -> int:
    return spark.read.schema("n int").parquet(f"{path}/folders").first().n


def _at(table: DataFrame, keys: list[int], folders: int) -> DataFrame:
    """Components looked for by one of some keys, out of those keys' folders. Keys are a query's, so they are few."""
    return table.filter(F.col("folder").isin(sorted({k % folders for k in keys})) & F.col("look").isin(keys))


def _near_keys(q: bytes) -> list[int]:
    """Keys of pieces that a component nearly equal to q can have."""
    keys = set()
    for least, off, parts in ((ONE_OFF, 1, 2), (TWO_OFF, 2, 3)):
        if len(q) < least:
            continue
        for n in range(len(q) - off, len(q) + off + 1):
            edges = _edges(n, parts)
            for i in range(parts):
                for shift in range(-off, off + 1):
                    a = edges[i] + shift
                    if 0 <= a and a + edges[i + 1] - edges[i] <= len(q):
                        keys.add(_key(f"{parts}/{i}/{n}:", q[a : a + edges[i + 1] - edges[i]]))
    return sorted(keys)


def components_like(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """Distinct components (component, hash) of the index that match one of a query's, in lower case."""
    q, folders, table = wanted.encode(), _folders(spark, path), spark.read.schema(COMPONENTS).parquet(f"{path}/components")
    parts = sorted({_key("=", q[a:b]) for a in range(len(q)) for b in range(a + 1, len(q) + 1)} | set(_near_keys(q)))
    found = _at(table, parts, folders).select("component", "hash")
    grams = sorted({_key("g", q[i : i + GRAM]) for i in range(len(q) - GRAM + 1)})
    if grams:
        held = _at(table, grams, folders).groupBy("component", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
        found = found.unionByName(held.select("component", "hash"))
    else:  # shorter than a gram: each component is looked at once, under its whole
        found = found.unionByName(table.filter(F.col("look") == F.col("hash")).select("component", "hash"))
    return found.distinct().filter(paths.component_matches(F.lit(wanted), F.col("component")))


def search(spark: SparkSession, path: str, query: str, physical: str, *others: str) -> DataFrame:
    """Rows of the index that paths.name_matches finds for the query, in the columns that it was built with."""
    rows, wanted = spark.read.parquet(f"{path}/rows"), query.strip().lower()
    rule = paths.name_matches(query, F.col(physical), *(F.col(c) for c in others))
    parts = [x for x in wanted.split("/") if x]
    if not parts:  # an empty query, or slashes alone
        return rows.filter(rule).drop("forms")
    like = components_like(spark, path, max(parts, key=lambda x: len(x.encode())))
    places = spark.read.schema(PLACES.format(rows.schema["key"].dataType.simpleString())).parquet(f"{path}/places")
    keys = places.join(like.select("hash", F.pmod("hash", F.lit(_folders(spark, path))).cast("int").alias("folder")), ["folder", "hash"], "left_semi").select("key").distinct()
    return rows.join(keys, "key", "left_semi").filter(rule).drop("forms")
