"""A table of symbols by URI that versions decide: hash partitions, a commit log, and rewrites of what a batch touches.

Each URI has the rows of its greatest ``seq``, in whatever order versions come;
one that has no symbols any more keeps a row without a name, so that older ones
stay out. A partition is one folder's files, named by the log; a batch writes the
partitions of its URIs anew and commits them together. A commit names the version
it has read, and a writer that read a stale one starts over or gives up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlens.functions import schema as S
from symlens.operators.store import recomputed
from symlens.sources.commits import CommitLog, StaleVersion
from symlens.sources.tables import settle

ROWS = f"{S.SYMBOLS}, seq long"


def latest_versions(batch: DataFrame) -> DataFrame:
    """Rows of the greatest ``seq`` of each ``request_uri``; older ones are dropped. A null one is older than any."""
    top = batch.groupBy("request_uri").agg(F.max("seq").alias("__top"))
    return batch.join(top, "request_uri").filter(F.col("seq").eqNullSafe(F.col("__top"))).select(*batch.columns)


class VersionedTable:
    """The table under ``path``, in ``parts`` partitions as it was made."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)
        self.parts = self.log.latest()[1].get("parts", parts)

    def _part(self):
        return (F.crc32("request_uri") % self.parts).cast("int")

    def _rows(self, state: dict, parts: list[int] | None = None) -> DataFrame:
        files = state.get("files", {})
        paths = [f"{self.path}/{files[str(p)]}/part={p}" for p in (range(self.parts) if parts is None else parts) if str(p) in files]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def rows(self) -> DataFrame:
        """Rows with their ``seq``, those of emptied URIs among them."""
        return self._rows(self.log.latest()[1])

    def symbols(self) -> DataFrame:
        """The symbols that the table holds now."""
        return self.rows().filter("name IS NOT NULL").drop("seq")

    def upsert(self, batch: DataFrame, writer: str = "", batch_id: int | None = None) -> int | None:
        """Put the versions of ``batch`` (symbol columns and ``seq``) in place; the version committed, or null if nothing was left to do.

        A row without a name ends its URI's symbols; rows without a URI are dropped. Versions not above the
        stored one change nothing. Of equal ids of a URI the first by ``ord``
        counts. A ``batch_id`` not above the last one of this ``writer`` is passed
        over, so that a batch run again does no harm. The driver sees the numbers
        of touched partitions alone. :class:`StaleVersion` if another writer was
        faster.
        """
        read, state = self.log.latest()
        done = state.get("writers", {})
        if batch_id is not None and done.get(writer, -1) >= batch_id:
            return None
        mark = {} if batch_id is None else {writer: batch_id}
        columns = [c.split()[0] for c in ROWS.split(", ")]
        given = latest_versions(batch.filter("request_uri IS NOT NULL").select(*columns))
        ended = given.filter("name IS NULL").dropDuplicates(["request_uri"])
        # an end beside symbols of the same version is none
        named = given.filter("name IS NOT NULL")
        new = settle(recomputed(named).unionByName(ended.join(named.select("request_uri").distinct(), "request_uri", "left_anti").select(*columns)).withColumn("__part", self._part()))
        touched = sorted(r[0] for r in new.select("__part").distinct().collect())
        if touched:
            old = self._rows(state, touched)
            of = lambda df: df.groupBy("request_uri").agg(F.max("seq").alias("__seq"), F.lit(True).alias("__known"))
            newer = new.join(of(old), "request_uri", "left").filter("__known IS NULL OR (seq IS NOT NULL AND (__seq IS NULL OR seq > __seq))").select(*columns)
            newer = settle(newer)
            touched = sorted(r[0] for r in newer.select(self._part()).distinct().collect())
        if not touched:
            if mark:
                return self.log.commit(read, state | {"parts": self.parts, "writers": done | mark})
            return None
        kept = self._rows(state, touched).join(newer.select("request_uri").distinct(), "request_uri", "left_anti").select(*columns)
        folder = f"data-{uuid.uuid4().hex}"
        rows = kept.unionByName(newer).withColumn("part", self._part())
        rows.repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        files = state.get("files", {}) | {str(p): folder for p in touched}
        return self.log.commit(read, {"parts": self.parts, "files": files, "writers": done | mark})

    def upsert_again(self, batch: DataFrame, writer: str = "", batch_id: int | None = None, times: int = 5) -> int | None:
        """:meth:`upsert`, from the start where another writer was faster, since versions and not turns decide."""
        for left in range(times - 1, -1, -1):
            try:
                return self.upsert(batch, writer, batch_id)
            except StaleVersion:
                if not left:
                    raise
        return None

    def drop_unused(self) -> list[str]:
        """Delete folders that the last version doesn't name. Readers of earlier versions must be done."""
        return self.log.drop_unnamed(set(self.log.latest()[1].get("files", {}).values()), "data-")
