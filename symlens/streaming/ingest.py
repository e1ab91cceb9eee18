"""Incremental upserts with Structured Streaming.

A stream of symbol rows replaces the symbols of each URI it names, by version: the
greatest ``seq`` of a URI counts, within a micro-batch and across them. A row
without a name is a tombstone. The table is a
:class:`~symlens.streaming.table.VersionedTable`, of which a batch rewrites what it
touches; a batch run again changes nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from symlens.streaming.table import VersionedTable


class ProgressLog(StreamingQueryListener):
    """Start, progress and end of streaming queries, as records of the ``symlens`` logger or what ``tell`` does with them."""

    def __init__(self, tell=logging.getLogger("symlens").info):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(f"started {event.id}")

    def onQueryProgress(self, event) -> None:
        self.tell(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        self.tell(f"idle {event.id}")

    def onQueryTerminated(self, event) -> None:
        self.tell(f"ended {event.id}" + (f": {event.exception}" if event.exception else ""))


def stream_upserts(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str, initial: DataFrame | None = None, parts: int = 64, **trigger) -> StreamingQuery:
    """Start a query that keeps the table under ``path``; see :func:`current`.

    ``initial`` are symbols of no version, older than any, with which a new table
    begins. ``trigger`` is what the query is started with, all that is there at
    once by default.
    """
    table = VersionedTable(spark, path, parts)
    if initial is not None and not table.log.versions():
        table.upsert(initial.withColumn("seq", F.lit(None).cast("long")))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        VersionedTable(batch.sparkSession, path, parts).upsert_again(batch, checkpoint, batch_id)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table after the last whole batch."""
    return VersionedTable(spark, path).symbols()
