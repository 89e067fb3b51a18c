"""Live refresh: batches of change events, told apart by what they touch, publish snapshots."""

from __future__ import annotations

import fcntl
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import snapshots
from ..sources.files import pruned


def relevance(path: Column, roots: list[str], docs: str, excludes: list[str] = ()) -> Column:
    """source, docs or null: what a changed path touches."""
    source = F.lit(False)
    for r in roots:
        source = source | (F.lit(r in ("", ".")) | (path == r) | path.startswith(f"{r}/"))
    note = path.startswith(f"{docs}/") & path.endswith(".md") & ~pruned(path)
    return F.when(note, "docs").when(source & ~pruned(path, list(excludes)), "source")


def cause(batch: DataFrame) -> str | None:
    """The cause of a batch (what): a source change beats a change of docs; none is ignored."""
    return {2: "source", 1: "docs"}.get(batch.agg(F.max(F.when(F.col("what") == "source", 2).when(F.col("what") == "docs", 1))).first()[0])


class Refresh:
    """foreachBatch handler that keeps the last good state, also over a restart.

    rebuild(cause) makes the tables, commit(tables) publishes them; both run for one batch at a time. What was
    done and what is pending stands in the state folder: a cause is noted before its refresh begins and
    crossed out once it is published, so a refresh that fails, or whose process dies, is repeated with the
    next batch or at the next start, whatever that one's cause. A batch that was done is skipped. The guard
    (for example the configuration) is read before the refresh, before the commit and after it: a change before
    the commit aborts it, one after it leaves the cause pending.
    """

    def __init__(self, spark: SparkSession, folder: str, rebuild: Callable[[str], dict[str, DataFrame]], commit: Callable[[dict[str, DataFrame]], str], guard: Callable[[], object] = lambda: None):
        self.spark, self.folder = spark, folder
        self.rebuild, self.commit, self.guard = rebuild, commit, guard
        state = snapshots.read_json(spark, folder, "refresh") or {}
        self.done, self.pending, self.generation, self.last = state.get("done", -1), state.get("pending"), state.get("generation", 0), state.get("last")
        self.errors: list[str] = []
        self.lock = threading.Lock()

    def _save(self) -> None:
        snapshots.write_json(self.spark, self.folder, "refresh", {"done": self.done, "pending": self.pending, "generation": self.generation, "last": self.last})

    def refresh(self, why: str | None) -> bool:
        """Refresh for a cause and for what is pending; whether nothing is pending after it."""
        why = "source" if "source" in (why, self.pending) else why or self.pending
        if not why:
            return True
        if self.pending != why:
            self.pending = why
            self._save()
        before = self.guard()
        try:
            tables = self.rebuild(why)
            if self.guard() != before:
                raise RuntimeError("configuration changed during the refresh")
            self.last = self.commit(tables)
            self.generation += 1
            if self.guard() != before:
                raise RuntimeError("configuration changed during the commit")
            self.pending = None
        except Exception as e:  # the last good state stays, and the cause stays pending
            self.errors.append(str(e))
        return self.pending is None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with self.lock:
            if batch_id <= self.done:
                return
            self.refresh(cause(batch))
            self.done = batch_id
            self._save()


def started(handler: Refresh, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a watch before the first build: events that come meanwhile wait for it, and none is missed."""
    with handler.lock:
        query = start()
        handler.refresh("source")
        handler._save()
    return query


class Revisions:
    """Results of loads that overlap: only the newest load may publish; older results are disposed of."""

    def __init__(self, dispose: Callable[[object], None] = lambda result: None):
        self.dispose, self.newest, self.current = dispose, 0, None
        self.lock = threading.Lock()

    def begin(self) -> int:
        with self.lock:
            self.newest += 1
            return self.newest

    def publish(self, revision: int, result: object) -> bool:
        """Whether the result became the current one."""
        with self.lock:
            old, fresh = self.current, revision == self.newest
            self.current = result if fresh else old
        if not fresh:
            self.dispose(result)
        elif old is not None and old is not result:
            self.dispose(old)
        return fresh


class Generations:
    """One streaming query for each configuration: a change stops the old one and starts the next.

    Where that fails, watching is suspended, the last committed state stays, and the next step tries again.
    """

    def __init__(self, configure: Callable[[], object], start: Callable[[object], StreamingQuery], retry: float = 1.0):
        self.configure, self.start, self.retry = configure, start, retry
        self.config: object = None
        self.query: StreamingQuery | None = None
        self.number, self.errors = 0, []

    def step(self) -> bool:
        """Look at the configuration once; whether a query is running after it."""
        try:
            config = self.configure()
            if self.query is not None and config == self.config and self.query.isActive:
                return True
            if self.query is not None:
                self.query.stop()
                self.query = None
            self.query, self.config = self.start(config), config
            self.number += 1
        except Exception as e:
            self.errors.append(str(e))
            return False
        return True

    def run(self, until: Callable[[], bool], every: float = 0.25) -> None:
        while not until():
            time.sleep(every if self.step() else self.retry)


def watch(events: DataFrame, handler: Refresh, checkpoint: str, roots: list[str], docs: str, every: str | None = None) -> StreamingQuery:
    """Run the handler over a stream of events (path): all that is there and then stop, or every so often."""
    told = events.select("path", relevance(F.col("path"), roots, docs).alias("what")).where("what is not null")
    writer = told.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def debounced(events: DataFrame, gap: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Sessions of events (ts, key) that follow each other within the gap; later ones than the watermark are dropped by it."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("events")).select("key", F.col("session_window.start").alias("first"), "events")


@contextmanager
def single_writer(path: str):
    """Hold a lock file of the driver; a second writer fails at once."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield


def incremental(before: DataFrame, files: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parsed rows (path, hash, ...) after a change: kept where path and hash are known, parsed anew elsewhere, gone where the file is."""
    kept = before.join(files.select("path", "hash"), ["path", "hash"], "left_semi")
    new = files.join(before.select("path", "hash"), ["path", "hash"], "left_anti")
    parsed = parse(new).join(new.select("path", "hash"), "path")
    return kept.unionByName(parsed.select(*kept.columns))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events (path) from JSON lines that other processes drop into a folder."""
    return spark.readStream.schema("path string, ts timestamp").json(folder)
