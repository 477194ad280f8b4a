"""Keeping an index up to date from a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from photonlake.operators.tables import newest


def arriving(spark: SparkSession, path: str, schema: str, files: int = 4096) -> DataFrame:
    """New Parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def pending(rows: DataFrame, index: DataFrame, key: str = "file_name", done: str = "phash_hex") -> DataFrame:
    """Rows whose work isn't done yet in the index."""
    return rows.join(index.filter(F.col(done).isNotNull()).select(key), key, "left_anti")


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions of a table that keep_up writes, in order; finished ones only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of a table that keep_up writes."""
    found = versions(spark, table)
    if not found:
        raise ValueError(f"{table} has no version yet")
    return spark.read.parquet(f"{table}/v={found[-1]}")


def keep_up(rows: DataFrame, table: str, checkpoint: str, key: str, order: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Keep the newest row of each key, by the order column, in versions of a Parquet table: table/v=N is made from the version before and micro-batch N. The order column stays in
    the table, so a row that comes in a later file but is older loses. A batch that runs again writes the same version again; versions before the last two go.
    Ends when nothing is left to read. Each batch rewrites the table, one row for each key, so batches should be large (see `arriving`)."""

    def step(batch: DataFrame, n: int) -> None:
        spark, new = batch.sparkSession, work(batch)
        before = [v for v in versions(spark, table) if v < n]
        old = spark.read.parquet(f"{table}/v={before[-1]}") if before else new.limit(0)
        newest(old, new, key, order).write.mode("overwrite").parquet(f"{table}/v={n}")
        for v in before[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_request(requests: DataFrame, key: str = "session", generation: str = "generation") -> DataFrame:
    """Of each session's requests the newest; older ones are superseded."""
    names = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.max_by(F.struct(*names), generation).alias("r")).select(key, "r.*")


def current(results: DataFrame, requests: DataFrame, key: str = "session", generation: str = "generation") -> DataFrame:
    """Results whose generation is their session's newest request; stale ones, and those of sessions without a request, go."""
    newest_ = requests.groupBy(key).agg(F.max(generation).alias(generation))
    return results.join(newest_, [key, generation], "left_semi")


def ring(events: DataFrame, source: str, order: str, most: int = 512) -> DataFrame:
    """Rows (source, events, dropped): the newest `most` events of each source in their order, and how many older ones were dropped. Each task keeps the newest of what it has seen, so
    no source has to fit one. order: unique within a source."""
    names = [c for c in events.columns if c not in (source, order)]
    best = Window.partitionBy(source).orderBy(F.col(order).desc())
    kept_ = events.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= most)
    lists = kept_.groupBy(source).agg(F.array_sort(F.collect_list(F.struct(order, *names))).alias("events"))
    sizes = events.groupBy(source).agg(F.count(F.lit(1)).alias("__all"))
    return sizes.join(lists, source).select(source, "events", (F.col("__all") - F.size("events")).alias("dropped"))


def answered(requests: DataFrame, phases: DataFrame) -> DataFrame:
    """Requests (at, phase, ...) with the time at which they can be answered: at once if the part of the data that they need (phases: phase, ready) is loaded, else when it is;
    null if it never is."""
    there = phases.groupBy("phase").agg(F.min("ready").alias("__ready"))
    return requests.join(there, "phase", "left").withColumn("answered", F.when(F.col("__ready").isNotNull(), F.greatest("at", "__ready"))).drop("__ready")
