"""Shared helpers: materialised intermediate tables and packed column codecs.

Iterative operators cut lineage by writing tables to the folder named in
``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs a
re-read of a file and never a recomputation of the whole chain.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside operators: ids order as if null came first.
NULL_ID = -(2**63)


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or what the context's checkpoint folder was set to.

    Only where the setting is absent and Spark runs on one machine (tests) a
    temporary folder is made and set for the session; on a cluster, whose
    executors wouldn't see it, that is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get("symlens.work.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symlens-")
        spark.conf.set("symlens.work.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or a longer one where a column already has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, *names: str) -> list[str]:
    """Columns of ``docs`` but those that an operator's own, called ``names``, replace."""
    own = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in own]


def id_key(name: str = "doc_id") -> Column:
    """The id as a non-null long; null becomes ``NULL_ID``."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_value(key: Column) -> Column:
    """The inverse of :func:`id_key`."""
    return F.when(key != F.lit(NULL_ID), key)


def text_bytes(name: str = "text") -> Column:
    """Whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, body): the two columns operators need, under names of their own."""
    return docs.select(id_key(id_col).alias("key"), text_bytes(text_col).alias("body"))
