"""Bursts of events by the clock, over a restart."""

import json
import time
from collections import Counter

from tracery.streaming.debounce import bursts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_one_emission_for_each_burst_and_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source, told = tmp_path / "events", tmp_path / "told"
    source.mkdir()

    def drop(name, rows):
        part = tmp_path / name
        part.write_text("\n".join(json.dumps({"root": r, "path": p}) for r, p in rows))
        part.rename(source / f"{name}.json")

    def start(gap):
        events = spark.readStream.schema("root string, path string").option("maxFilesPerTrigger", 1).json(str(source))
        out = bursts(events, gap).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds")
        return out.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{told}/batch={i}")).start()  # a batch that is run again replaces its rows

    def rows():
        return [tuple(r) for r in spark.read.schema("root string, burst long, path string, events long, batch long").parquet(str(told)).drop("batch").collect()] if told.exists() else []

    def wait(n, seconds=120):
        end = time.time() + seconds
        while time.time() < end and len(rows()) < n:
            assert query.isActive, query.exception()
            time.sleep(0.2)
        return rows()

    drop("a", [("src", "x"), ("src", "y"), (None, "z"), ("src", None)])
    drop("b", [("src", "x"), ("docs", "n")])
    query = start(6000)
    try:
        first = wait(3)
        assert sorted(first) == [("docs", 1, "n", 1), ("src", 1, "x", 2), ("src", 1, "y", 1)]
        drop("c", [("src", "w")])
        end, seen = time.time() + 60, len(query.recentProgress)
        while time.time() < end and not any(p["numInputRows"] for p in query.recentProgress[seen:]):
            time.sleep(0.1)
    finally:
        query.stop()
    before = rows()
    query = start(6000)
    try:
        wait(len(first) + 1)
        drop("d", [("src", "x")])
        wait(len(first) + 2)
    finally:
        query.stop()
    assert len(before) in (3, 4)  # told before the stop only if that took longer than the gap
    assert Counter(rows()) == Counter([*first, ("src", 2, "w", 1), ("src", 3, "x", 1)])
