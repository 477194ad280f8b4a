"""Streams with state: late and repeated requests, rings and their drop counts, stale results, restarts and timers."""

import random
import time
import uuid

import pytest

from photonlake.operators import versioned
from photonlake.plans.storage import shared_dir
from photonlake.streaming import index_stream, sessions


@pytest.fixture
def base(spark):
    return f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"


def put(spark, folder, rows, schema, n=[0]):
    """A file that comes after the ones before."""
    n[0] += 1
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


REQUESTS = "session string, generation long, request string"


def test_latest_requests_over_three_batches_and_a_restart(spark, base):
    def run():
        rows = index_stream.arriving(spark, f"{base}/in", REQUESTS, 1)
        sessions.into_table(sessions.latest_requests(rows), f"{base}/out", f"{base}/check", "session", "generation", 4).awaitTermination()
        return {r.session: (r.generation, r.request, r.received) for r in versioned.read(spark, f"{base}/out").collect()}

    put(spark, f"{base}/in", [("a", 1, "a1"), ("a", 3, "a3"), ("a", 2, "a2"), ("b", 5, "b5"), (None, 1, "x"), ("c", None, "y")], REQUESTS)
    put(spark, f"{base}/in", [("a", 2, "late"), ("b", 5, "repeated"), ("b", 6, "b6")], REQUESTS)
    assert run() == {"a": (3, "a3", 3), "b": (6, "b6", 3)}
    put(spark, f"{base}/in", [("a", 4, "a4"), ("b", 1, "late"), ("d", 1, "d1")], REQUESTS)
    assert run() == {"a": (4, "a4", 5), "b": (6, "b6", 3), "d": (1, "d1", 1)}
    assert run()["a"] == (4, "a4", 5)


EVENTS = "source string, seq long, event string"


@pytest.mark.parametrize("most", [5, 512])
def test_rings_against_brute_force(spark, base, most):
    rnd = random.Random(most)
    seqs = [(s, i) for s, n in (("hot", 700 if most == 512 else 60), ("few", 3), ("some", 12)) for i in range(n)]
    rnd.shuffle(seqs)
    parts = [seqs[i::3] for i in range(3)]
    parts[1] = parts[1] + sorted(parts[0])[-2:]  # the newest of one that are there already
    held, dropped = {}, {}
    for part in parts:
        put(spark, f"{base}/in", [(s, i, f"e{i}") for s, i in part], EVENTS)
        for s in {s for s, _ in part}:
            new = sorted({i for x, i in part if x == s} | set(held.get(s, ())))
            dropped[s] = dropped.get(s, 0) + max(0, len(new) - most)
            held[s] = new[-most:]
        rows = index_stream.arriving(spark, f"{base}/in", EVENTS, 1)
        sessions.into_table(sessions.rings(rows, most), f"{base}/out", f"{base}/check", "source", "last", 2, work=lambda df: df.selectExpr("*", "struct(size(events) + dropped AS n, element_at(events, -1).seq AS s) AS last")).awaitTermination()
    got = {r.source: ([e.seq for e in r.events], [e.event for e in r.events], r.dropped) for r in versioned.read(spark, f"{base}/out").collect()}
    assert got == {s: (held[s], [f"e{i}" for i in held[s]], dropped[s]) for s in held}


def test_stale_results_go(spark, base):
    def run():
        asked = index_stream.arriving(spark, f"{base}/asked", "session string, generation long", 1)
        found = index_stream.arriving(spark, f"{base}/found", "session string, generation long, result string", 1)
        sessions.into_files(sessions.current_results(asked, found), f"{base}/out", f"{base}/check").awaitTermination()
        return sorted(tuple(r)[:3] for r in spark.read.parquet(f"{base}/out").select("session", "generation", "result").collect())

    put(spark, f"{base}/asked", [("a", 1), ("b", 4), ("b", 2)], "session string, generation long")
    put(spark, f"{base}/found", [("a", 1, "one"), ("b", 2, "stale"), ("c", 1, "never asked")], "session string, generation long, result string")
    assert run() == [("a", 1, "one")]
    put(spark, f"{base}/asked", [("a", 2)], "session string, generation long")
    put(spark, f"{base}/found", [("a", 1, "stale now"), ("a", 2, "two"), ("b", 4, "four")], "session string, generation long, result string")
    assert run() == [("a", 1, "one"), ("a", 2, "two"), ("b", 4, "four")]


def test_silent_sessions_are_forgotten(spark, base):
    """A session whose timer has run out starts again with an older generation; one that isn't silent doesn't."""
    put(spark, f"{base}/in", [("a", 9, "nine")], REQUESTS)
    rows = index_stream.arriving(spark, f"{base}/in", REQUESTS, 1)
    running = sessions.into_table(sessions.latest_requests(rows, idle=1500), f"{base}/out", f"{base}/check", "session", "received", 2, every="100 milliseconds")
    try:
        def wait(done, seconds=40):
            end = time.time() + seconds
            while time.time() < end and not (versioned.versions(spark, f"{base}/out") and done({r.session: r.generation for r in versioned.read(spark, f"{base}/out").collect()})):
                time.sleep(0.2)
            return {r.session: r.generation for r in versioned.read(spark, f"{base}/out").collect()}

        assert wait(lambda x: "a" in x)["a"] == 9
        time.sleep(4)
        put(spark, f"{base}/in", [("a", 2, "two"), ("b", 5, "five")], REQUESTS)
        assert wait(lambda x: x.get("a") == 2) == {"a": 2, "b": 5}
    finally:
        running.stop()


def test_the_session_keeps_its_store(spark, base):
    before = spark.conf.get(sessions.STORE[0])
    put(spark, f"{base}/in", [("a", 1, "x")], REQUESTS)
    sessions.into_table(sessions.latest_requests(index_stream.arriving(spark, f"{base}/in", REQUESTS)), f"{base}/out", f"{base}/check", "session", "generation", 2).awaitTermination()
    assert spark.conf.get(sessions.STORE[0]) == before
