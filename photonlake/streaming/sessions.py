"""State of sessions and sources, kept by Structured Streaming from one micro-batch to the next and across restarts.

Each key has its own state, so keys spread over tasks. What a task of a micro-batch reads is reduced before it is shuffled (the newest request of each session, the newest events of each source), so a key
that has most of the rows comes to its state as a few. States that nothing has come for in a while are given up, by a timer of processing time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from photonlake.operators import versioned
from photonlake.plans.storage import kept

#: State lives in this store, which keys with several values and timers need.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds after which a silent key's state goes; 0: never. Timers come due without new rows, so a stream with them has no end: run it with `every`.
IDLE = 0
#: Rows of a task that wait before they are put together with the sessions held, at least.
MERGE_ROWS = 100_000


class _Idle(StatefulProcessor):
    """A processor whose keys are given up after `idle` milliseconds without rows."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states(handle)

    def seen(self, timers) -> None:
        if not self.idle:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, (tuple, Row)) else t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class _Latest(_Idle):
    """The newest request of a session; older and repeated ones change nothing but the count of those received."""

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "generation long, request string, received long")

    def forget(self) -> None:
        self.now.clear()

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:  # noqa: N802
        generation, request, received = tuple(self.now.get()) if self.now.exists() else (None, None, 0)
        before = generation
        for r in rows:
            received += r.received
            if generation is None or r.generation > generation:
                generation, request = r.generation, r.request
        self.now.update((generation, request, received))
        self.seen(timers)
        if generation != before:
            yield Row(session=key[0], generation=generation, request=request, received=received)


class _Current(_Idle):
    """Results whose generation is the session's newest request by then."""

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "generation long")

    def forget(self) -> None:
        self.newest.clear()

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:  # noqa: N802
        newest = self.newest.get()[0] if self.newest.exists() else None
        results = []
        for r in rows:
            if r.result is not None:
                results.append(r)
            elif newest is None or r.generation > newest:
                newest = r.generation
        if newest is not None:
            self.newest.update((newest,))
        self.seen(timers)
        for r in results:
            if r.generation == newest:
                yield Row(session=key[0], generation=r.generation, result=r.result)


class _Ring(_Idle):
    """The newest events of a source and how many have been dropped."""

    def __init__(self, most: int, idle: int):
        super().__init__(idle)
        self.most = most

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "seq long", "event string")
        self.dropped = handle.getValueState("dropped", "n long")

    def forget(self) -> None:
        self.events.clear()
        self.dropped.clear()

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:  # noqa: N802
        held = {k[0]: v[0] for k, v in self.events.iterator()} if self.events.exists() else {}
        dropped = self.dropped.get()[0] if self.dropped.exists() else 0
        new = {}
        for r in rows:
            dropped += r.dropped
            if r.seq is not None and r.seq not in held:
                new[r.seq] = r.event
        both = sorted(held | new)
        gone, stay = both[: max(0, len(both) - self.most)], both[max(0, len(both) - self.most) :]
        for seq in gone:
            if seq in held:
                self.events.removeKey((seq,))
        for seq in stay:
            if seq in new:
                self.events.updateValue((seq,), (new[seq],))
        self.dropped.update((dropped + len(gone),))
        self.seen(timers)
        yield Row(source=key[0], events=[(s, new.get(s, held.get(s))) for s in stay], dropped=dropped + len(gone))


def _timed(idle: int) -> str:
    return "ProcessingTime" if idle else "None"


def _newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest request of each session among a task's rows, and how many came. Rows wait until there are as many as sessions held, so each is sorted a few times however many sessions there are."""
    best, waiting, n = None, [], 0

    def merged() -> pd.DataFrame:
        f = pd.concat(waiting if best is None else [best, *waiting])
        come = f.groupby("session")["received"].sum()
        f = f.sort_values("generation", ascending=False, kind="stable").drop_duplicates("session")
        return f.assign(received=f["session"].map(come).astype("int64"))

    for f in frames:
        waiting.append(f.assign(received=1))
        n += len(f)
        if n >= max(MERGE_ROWS, 0 if best is None else len(best)):
            best, waiting, n = merged(), [], 0
    if n:
        best = merged()
    if best is not None and len(best):
        yield best[["session", "generation", "request", "received"]]


def latest_requests(requests: DataFrame, idle: int = IDLE) -> DataFrame:
    """A stream of (session, generation, request) as a stream of each session's newest request whenever a newer one comes, with how many have come so far: all but the newest are superseded or
    repeats. Of equal generations one counts; a null generation or session is no request."""

    kind = requests.schema["session"].dataType.simpleString()
    rows = requests.filter("session IS NOT NULL AND generation IS NOT NULL").select("session", F.col("generation").cast("long").alias("generation"), F.col("request").cast("string").alias("request"))
    few = rows.mapInPandas(_newest, f"session {kind}, generation long, request string, received long")
    return few.groupBy("session").transformWithState(_Latest(idle), f"session {kind}, generation long, request string, received long", "Update", _timed(idle))


def current_results(requests: DataFrame, results: DataFrame, idle: int = IDLE) -> DataFrame:
    """Results (session, generation, result) whose generation is the session's newest request (session, generation) when they come; of one micro-batch the requests count first. Stale ones go."""
    both = requests.select("session", F.col("generation").cast("long").alias("generation"), F.lit(None).cast("string").alias("result")).unionByName(
        results.filter("result IS NOT NULL").select("session", F.col("generation").cast("long").alias("generation"), F.col("result").cast("string").alias("result"))
    )
    kind = both.schema["session"].dataType.simpleString()
    return both.filter("session IS NOT NULL AND generation IS NOT NULL").groupBy("session").transformWithState(_Current(idle), f"session {kind}, generation long, result string", "Append", _timed(idle))


def rings(events: DataFrame, most: int = 512, idle: int = IDLE) -> DataFrame:
    """A stream of (source, seq, event) as a stream of each source's newest `most` events in order, whenever some come, and how many have been dropped. An event that is there already changes
    nothing; one that comes when a full ring has only newer ones is dropped at once, each time it comes."""

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        gone: dict = {}
        for f in frames:
            both = (f if held is None else pd.concat([held, f])).drop_duplicates(["source", "seq"]).sort_values("seq", ascending=False, kind="stable")
            stay = both.groupby("source", sort=False).cumcount() < most
            for source, n in both[~stay].groupby("source").size().items():
                gone[source] = gone.get(source, 0) + int(n)
            held = both[stay]
        if held is not None and len(held):
            yield held.assign(dropped=0)[["source", "seq", "event", "dropped"]]
            if gone:
                yield pd.DataFrame({"source": list(gone), "seq": pd.array([None] * len(gone), dtype="Int64"), "event": [None] * len(gone), "dropped": list(gone.values())})

    kind = events.schema["source"].dataType.simpleString()
    rows = events.filter("source IS NOT NULL AND seq IS NOT NULL").select("source", F.col("seq").cast("long").alias("seq"), F.col("event").cast("string").alias("event"))
    few = rows.mapInPandas(reduce, f"source {kind}, seq long, event string, dropped long")
    return few.groupBy("source").transformWithState(_Ring(most, idle), f"source {kind}, events array<struct<seq:long,event:string>>, dropped long", "Update", _timed(idle))


def _started(rows: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str, every: str | None = None) -> StreamingQuery:
    """A stream run to the end of what there is, or, with `every`, on and on until it is stopped. Its session is cloned at the start, so the setting of the state's store is put back right after."""
    conf = rows.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return rows.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        conf.set(STORE[0], before) if before else conf.unset(STORE[0])


def into_table(rows: DataFrame, table: str, checkpoint: str, key: str, order: str, buckets: int = 64, mode: str = "update", work: Callable[[DataFrame], DataFrame] = lambda df: df, every: str | None = None) -> StreamingQuery:
    """Keep the newest row of each key, by the order column, in a bucketed table (versioned): a micro-batch writes the buckets that it touches, a late older row loses, and a batch that runs again
    changes nothing."""

    def step(batch: DataFrame, n: int) -> None:
        # Written once: the rows of a batch with state are computed once, and to their end.
        spark, new = batch.sparkSession, kept(work(batch), "batch")
        if not versioned.versions(spark, table):
            versioned.create(new.limit(0), table, key, buckets)
        versioned.upsert(new, table, order, n)
        versioned.vacuum(spark, table)

    return _started(rows, checkpoint, step, mode, every)


def into_files(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows: a folder for each micro-batch, written over if it runs again."""
    return _started(rows, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"), "append")
