"""Versions across batches, commits, and the debounce of a stream."""

import time

import pytest
from pyspark.sql import functions as F

from symlens.functions.schema import SYMBOLS
from symlens.sources.commits import StaleVersion
from symlens.streaming import ingest
from symlens.streaming.debounce import STATE_STORE, debounced
from symlens.streaming.table import VersionedTable, latest_versions

SCHEMA = f"{SYMBOLS}, seq long"


def row(name, uri, seq, i=0):
    return ("", name, 12, None, f"file:///{uri}", i, 0, i, 0, None, None, None, None, f"file:///{uri}", i, seq)


def names(table):
    return sorted((r.request_uri[8:], r.name) for r in table.symbols().collect())


def test_versions_decide_across_batches(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", parts=4)
    put = lambda *rows, **k: table.upsert(spark.createDataFrame(list(rows), SCHEMA), **k)
    assert table.symbols().count() == 0 and put() is None
    put(row("a5", "a", 5), row("a5", "a", 5), row("x", "a", 5, 1), row("a4", "a", 4), row("b1", "b", 1), row("n", "n", None), ("", "lost", *row("x", "x", 9)[2:13], None, 0, 9))
    assert names(table) == [("a", "a5"), ("a", "x"), ("b", "b1"), ("n", "n")]
    before = table.log.latest()[1]["files"]
    assert put(row("a3", "a", 3), row("late", "a", 5), row("n", "n", None)) is None  # older or equal: nothing is written
    assert table.log.latest()[1]["files"] == before
    put(row(None, "b", 7), row("a6", "a", 6))
    put(row("b6", "b", 6))  # older than the end of its file
    assert names(table) == [("a", "a6"), ("n", "n")]
    put(row("b8", "b", 8), row(None, "b", 8), row("n2", "n", 0))
    assert names(table) == [("a", "a6"), ("b", "b8"), ("n", "n2")]
    assert latest_versions(spark.createDataFrame([row("p", "p", None), row("q", "q", 1), row("q0", "q", None)], SCHEMA)).count() == 2


def test_a_batch_writes_the_partitions_that_it_touches(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", parts=32)
    table.upsert(spark.createDataFrame([row("s", f"f{i}", 1) for i in range(300)], SCHEMA))
    first = table.log.latest()[1]["files"]
    assert len(first) == 32
    table.upsert(spark.createDataFrame([row("t", "f7", 2)], SCHEMA), "w", 3)
    after = table.log.latest()[1]["files"]
    assert sum(after[p] != first[p] for p in after) == 1 and len([p for p in tmp_path.glob("t/data-*/part=*")]) == 33
    assert table.upsert(spark.createDataFrame([row("u", "f7", 9)], SCHEMA), "w", 3) is None  # the batch ran before
    assert len(names(table)) == 300 and ("f7", "t") in names(table)
    table.upsert(spark.createDataFrame([row("u", f"f{i}", 9) for i in range(300)], SCHEMA))
    assert len(table.drop_unused()) == 2 and len(names(table)) == 300


def test_a_stale_writer_is_refused(spark, tmp_path, monkeypatch):
    table, other = (VersionedTable(spark, f"file://{tmp_path}/t", parts=2) for _ in range(2))
    table.upsert(spark.createDataFrame([row("a", "a", 1)], SCHEMA))
    read = table.log.latest()
    other.upsert(spark.createDataFrame([row("b", "a", 2)], SCHEMA))
    turns = [read]
    monkeypatch.setattr(table.log, "latest", lambda: turns.pop() if turns else type(table.log).latest(table.log))
    with pytest.raises(StaleVersion):
        table.upsert(spark.createDataFrame([row("c", "a", 3)], SCHEMA))
    turns.append(read)
    table.upsert_again(spark.createDataFrame([row("c", "a", 3)], SCHEMA))
    assert names(table) == [("a", "c")]


def test_a_stream_in_any_order(spark, tmp_path):
    files = [[row("a9", "a", 9)], [row("a1", "a", 1), row("b1", "b", 1)], [row(None, "b", 4)], [row("b2", "b", 2), row("c1", "c", 1)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        ingest.stream_upserts(spark, stream, f"file://{tmp_path}/t", f"{tmp_path}/c", parts=4).awaitTermination()
    assert sorted(r.name for r in ingest.current(spark, f"file://{tmp_path}/t").collect()) == ["a9", "c1"]


def test_debounce_keeps_the_last_version(spark, tmp_path):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    got: list = []

    def put(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def waited(n):
        end = time.time() + 60
        while len(got) < n and time.time() < end:
            time.sleep(0.2)
        return sorted((r.request_uri[8:], r.name or "", r.seq, r.versions) for r in got)

    try:
        put(row("a1", "a", 1), row("a3", "a", 3), row("x3", "a", 3, 1), row("a2", "a", 2), row("b5", "b", 5), row("none", "b", None))
        stream = debounced(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="50 milliseconds").start()
        first = [("a", "a3", 3, 3), ("a", "x3", 3, 3), ("b", "b5", 5, 1)]
        assert waited(3) == first
        put(row("a2", "a", 2), row("late", "a", 3), row("b4", "b", 4))  # older than what was let through
        put(row(None, "b", 6), row("a7", "a", 7))
        waited(5)
        assert {(r.name, r.seq, r.versions) for r in got} == {("a3", 3, 3), ("x3", 3, 3), ("b5", 5, 1), ("a7", 7, 1), (None, 6, 1)}
        time.sleep(2)
        assert len(got) == 5 and query.isActive
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
