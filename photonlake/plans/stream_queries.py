"""Queries over streams of files, each run to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from photonlake.operators import versioned
from photonlake.plans.registry import query, table
from photonlake.plans.storage import kept, shared_dir
from photonlake.streaming import index_stream, sessions


def _source(spark, d):
    """Events in files of a folder, as they would arrive."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))
    where = f"{shared_dir(spark)}/photonlake-arriving-{uuid.uuid4().hex}"
    rows.repartition(4, "event_id").write.parquet(where)
    return where, rows.schema


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 4), event_id) AS value FROM events GROUP BY user_id")
def str1_incremental(spark, d):
    """Micro-batches upserted into a table: the newest event of each user, in whatever file it comes."""
    where, schema = _source(spark, d)
    base = f"{shared_dir(spark)}/photonlake-stream-{uuid.uuid4().hex}"
    index_stream.keep_up(index_stream.arriving(spark, where, schema, 2), f"{base}/table", f"{base}/checkpoint", "user_id", "event_id").awaitTermination()
    return index_stream.latest(spark, f"{base}/table").select("user_id", "event_type", "value")


@query("SELECT event_id FROM events")
def str2_drained(spark, d):
    """A folder drained a few files at a time, in order at the end."""
    where, schema = _source(spark, d)
    base = f"{shared_dir(spark)}/photonlake-drained-{uuid.uuid4().hex}"
    q = index_stream.arriving(spark, where, schema, 1).select("event_id").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").orderBy("event_id")


@query("SELECT user_id AS session, max(event_id) AS generation, arg_max(event_type, event_id) AS request FROM events GROUP BY user_id")
def str4_newest_request(spark, d):
    """Only the newest request of each session counts."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("generation"), F.col("event_type").alias("request"))
    return index_stream.newest_request(rows).select("session", "generation", "request")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def str6_resumed(spark, d):
    """Work that a run before had finished isn't done again."""
    rows = table(spark, d, "events").select("event_id")
    done = kept(rows.filter("event_id % 3 = 0").withColumn("phash_hex", F.lit("x")), "done")
    return index_stream.pending(rows, done, "event_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, max(event_id) OVER (PARTITION BY user_id) AS newest FROM events) WHERE event_id = newest")
def str3_current_results(spark, d):
    """Results of requests that a newer one has superseded are left out."""
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_id").alias("generation"))
    return index_stream.current(rows, rows.select("session", "generation")).select("event_id", F.col("session").alias("user_id"))


@query("""SELECT event_type, list(event_id ORDER BY event_id) FILTER (WHERE n <= 512) AS ids, count(*) FILTER (WHERE n > 512) AS dropped
FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) GROUP BY event_type""")
def str5_ring(spark, d):
    """The newest 512 events of each kind, and how many were dropped."""
    found = index_stream.ring(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id")
    return found.select("event_type", F.col("events.event_id").alias("ids"), "dropped")


@query("""WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS asked FROM events), p AS (SELECT event_type,
min(asked) FILTER (WHERE event_id % 97 = 0) AS ready FROM e WHERE event_type <> 'click' GROUP BY event_type)
SELECT e.event_id, CASE WHEN p.ready IS NOT NULL THEN greatest(e.asked, p.ready) END AS answered FROM e LEFT JOIN p USING (event_type)""")
def str7_answered(spark, d):
    """Requests that need data of a later phase of loading wait for it."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("phase"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    phases = rows.filter("event_id % 97 = 0 AND phase <> 'click'").select("phase", F.col("at").alias("ready"))
    return index_stream.answered(rows, phases).select("event_id", "answered")


def _arriving(spark, rows, order, schema):
    """Rows in four files of a folder, read one at a time, oldest first; each file has all kinds of old and new rows."""
    where = f"{shared_dir(spark)}/photonlake-arriving-{uuid.uuid4().hex}"
    rows.repartition(4, order).write.parquet(where)
    return index_stream.arriving(spark, where, schema, 1)


@query("SELECT user_id AS session, max(event_id) AS generation, arg_max(event_type, event_id) AS request FROM events GROUP BY user_id")
def str4_stream(spark, d):
    """The newest request of each session, as state over micro-batches, in a bucketed table."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("generation"), F.col("event_type").alias("request"))
    base = f"{shared_dir(spark)}/photonlake-requests-{uuid.uuid4().hex}"
    stream = sessions.latest_requests(_arriving(spark, rows, "generation", rows.schema))
    sessions.into_table(stream, f"{base}/out", f"{base}/check", "session", "generation", 8).awaitTermination()
    return versioned.read(spark, f"{base}/out").select("session", "generation", "request")


@query("""SELECT event_type, list(event_id ORDER BY event_id) FILTER (WHERE n <= 64) AS ids, count(*) FILTER (WHERE n > 64) AS dropped
FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) GROUP BY event_type""")
def str5_stream(spark, d):
    """Rings of the newest 64 events of each kind, as state over micro-batches in which the events come in no order."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.lit("e").alias("event"))
    base = f"{shared_dir(spark)}/photonlake-rings-{uuid.uuid4().hex}"
    stream = sessions.rings(_arriving(spark, rows, "seq", rows.schema), 64)
    sessions.into_table(stream, f"{base}/out", f"{base}/check", "source", "come", 2, work=lambda df: df.withColumn("come", F.size("events") + F.col("dropped"))).awaitTermination()
    return versioned.read(spark, f"{base}/out").select(F.col("source").alias("event_type"), F.col("events.seq").alias("ids"), "dropped")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, max(event_id) OVER (PARTITION BY user_id) AS newest FROM events) WHERE event_id = newest")
def str3_stream(spark, d):
    """Results that come after their requests, in a run that takes up the state of the run before: those of requests that a newer one has superseded go."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("generation"), F.col("event_type").alias("result"))
    base = f"{shared_dir(spark)}/photonlake-results-{uuid.uuid4().hex}"
    rows.drop("result").repartition(2, "generation").write.parquet(f"{base}/asked")
    for found in (rows.limit(0), rows):
        found.repartition(2, "generation").write.mode("append").parquet(f"{base}/found")
        asked, results = index_stream.arriving(spark, f"{base}/asked", rows.drop("result").schema), index_stream.arriving(spark, f"{base}/found", rows.schema)
        sessions.into_files(sessions.current_results(asked, results), f"{base}/out", f"{base}/check").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("generation").alias("event_id"), F.col("session").alias("user_id"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 4), event_id) AS value FROM events GROUP BY user_id")
def str1_bucketed(spark, d):
    """Micro-batches upserted into a bucketed table: each writes the buckets that it touches."""
    where, schema = _source(spark, d)
    base = f"{shared_dir(spark)}/photonlake-buckets-{uuid.uuid4().hex}"
    sessions.into_table(index_stream.arriving(spark, where, schema, 2), f"{base}/table", f"{base}/check", "user_id", "event_id", 8, mode="append").awaitTermination()
    return versioned.read(spark, f"{base}/table").select("user_id", "event_type", "value")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0""")
def snk11_versions(spark, d):
    """A table after a deletion, a checked patch and a patch that is refused, as it was planned on the version before."""
    where = f"{shared_dir(spark)}/photonlake-versions-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    versioned.create(rows, where, "c_custkey", 8)
    patch = rows.filter("c_custkey % 10 = 0 AND c_custkey % 7 <> 0").select("c_custkey", F.lit("patched").alias("c_mktsegment"))
    late = versioned.plan(spark, where, patch.withColumn("c_mktsegment", F.lit("late")))
    versioned.delete(rows.filter("c_custkey % 7 = 0"), where)
    versioned.apply(spark, versioned.plan(spark, where, patch), "patch", lambda df: F.col("c_mktsegment") != "")
    try:
        versioned.apply(spark, late, "late")
    except versioned.Conflict:
        return versioned.read(spark, where)
    raise AssertionError("a patch planned on version 1 was applied to a later one")


@query("""SELECT count(*) AS n, TRUE AS refused, TRUE AS undone FROM orders""")
def rel14_guarded(spark, d):
    """Guards of a table: a patch is refused if a file that it relies on has changed, and one that was interrupted is undone from its journal."""
    where = f"{shared_dir(spark)}/photonlake-guards-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    versioned.create(rows, f"{where}/table", "o_orderkey", 8)
    patch = rows.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    signed = f"{where}/signed"
    patch.limit(1).select("o_orderstatus").coalesce(1).write.text(signed)
    planned = versioned.plan(spark, f"{where}/table", patch, [signed + "/_SUCCESS"])
    planned["signatures"][signed + "/_SUCCESS"][0] += 1  # another size than the file has
    refused = undone = False
    try:
        versioned.apply(spark, planned, "changed")
    except versioned.Conflict:
        refused = True

    def stop(step):
        if step == "committed":
            raise KeyboardInterrupt

    try:
        versioned.apply(spark, versioned.plan(spark, f"{where}/table", patch), "broken", fail=stop)
    except KeyboardInterrupt:
        undone = versioned.recover(spark, f"{where}/table") == ["broken"]
    left = versioned.read(spark, f"{where}/table").join(rows, ["o_orderkey", "o_orderstatus"], "left_semi")
    return left.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(refused).alias("refused"), F.lit(undone).alias("undone"))
