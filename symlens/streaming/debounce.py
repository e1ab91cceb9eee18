"""Debounce of a stream of versions: a URI's latest one is let through when none has followed for a while.

State is kept by URI: the rows of the greatest ``seq`` seen, and a timer that each
newer version sets anew. Older versions are dropped, before and after the release.
Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds without a newer version, after which one is let through.
WAIT_MS = 150
#: The state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Rows (request_uri, seq, payload) of a URI to those of its latest version, with ``versions``, how many were merged into it."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seq long, due long, versions long")
        self.held = handle.getListState("held", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, due, versions = self.seen.get() if self.seen.exists() else (None, None, 0)
        for frame in rows:
            for own in sorted({int(s) for s in frame["seq"]}):
                if seq is not None and (own < seq or own == seq and due is None):
                    continue  # older, or released already
                payloads = [(p,) for p in frame.loc[frame["seq"] == own, "payload"]]
                if own == seq:
                    self.held.appendList(payloads)
                else:
                    self.held.put(payloads)
                    versions += 1
                if due is not None:
                    self.handle.deleteTimer(due)
                seq, due = own, timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                self.handle.registerTimer(due)
                self.seen.update((seq, due, versions))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, due, versions = self.seen.get()
        if due is not None and due == expiredTimerInfo.getExpiryTimeInMs():
            payloads = [p for (p,) in self.held.get()]
            self.held.clear()
            self.seen.update((seq, None, 0))
            yield pd.DataFrame({"request_uri": [key[0]] * len(payloads), "seq": [seq] * len(payloads), "payload": payloads, "versions": [versions] * len(payloads)})

    def close(self) -> None:
        pass


def debounced(rows: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """The stream ``rows`` (request_uri, seq, ...) with only the versions that no newer one followed within ``wait_ms``, and ``versions``.

    Rows of one version may come in several batches; a URI's rows are let through
    together. Time is that of processing. Rows without a URI or a ``seq`` are
    dropped.
    """
    kind = rows.schema.simpleString()
    packed = rows.filter("request_uri IS NOT NULL AND seq IS NOT NULL").select("request_uri", F.col("seq").cast("long").alias("seq"), F.to_json(F.struct(*rows.columns)).alias("payload"))
    out = packed.groupBy("request_uri").transformWithStateInPandas(
        statefulProcessor=Debounce(wait_ms), outputStructType="request_uri string, seq long, payload string, versions long", outputMode="Append", timeMode="ProcessingTime"
    )
    return out.select(F.from_json("payload", kind).alias("r"), "versions").select("r.*", "versions")
