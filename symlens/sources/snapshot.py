"""Snapshots: tables in parts, and a manifest that is switched in one step.

Rows are dealt to parts by a hash of a key, and a part's digest says whether it
has changed since the version before; only those that have are written. The new
manifest is one commit, so that whatever fails before it leaves the snapshot as it
was. File work goes through Hadoop's file system, so any store that Spark reads
will do.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symlens.functions.exprs import safe_name
from symlens.sources.commits import CommitLog

VERSION = 2
#: The column by which a table's rows are dealt to parts; the first one for other tables.
KEYS = {"symbols": "request_uri", "hotspots": "uri", "edges": "caller_symbol_id"}
PARTS = 16


def exists(spark: SparkSession, path: str) -> bool:
    return bool(CommitLog(spark, path).versions())


def _dealt(df: DataFrame, name: str, parts: int) -> DataFrame:
    key = KEYS[name] if KEYS.get(name) in df.columns else df.columns[0]
    return df.withColumn("part", (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts).cast("int"))


def _digests(rows: DataFrame) -> dict[int, str]:
    """A digest of each part's rows, whatever their order. The driver gets a row a part."""
    columns = [c for c in rows.columns if c != "part"]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string").alias(f"s{seed}") for seed in (1, 2)]
    found = rows.groupBy("part").agg(F.count("*").alias("n"), *sums).collect()
    return {r.part: hashlib.sha256(f"{r.n}:{r.s1}:{r.s2}".encode()).hexdigest() for r in found}


def write(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], parts: int = PARTS) -> int:
    """Make ``tables`` the snapshot under ``path``; returns how many parts were written.

    A part whose rows the last version has is named again and not written. A
    table is read twice, for its digests and its rows.
    :class:`~symlens.sources.commits.StaleVersion` if another writer was faster.
    """
    log = CommitLog(spark, path)
    read, before = log.latest()
    parts = before.get("parts", parts) if before.get("version") == VERSION else parts
    state: dict = {"version": VERSION, "parts": parts, "tables": {}}
    written = 0
    for name, df in tables.items():
        rows = _dealt(df, name, parts)
        old = before.get("tables", {}).get(name, {}).get("parts", {}) if before.get("version") == VERSION else {}
        digests = _digests(rows)
        held = {p: old[str(p)] for p, d in digests.items() if old.get(str(p), {}).get("digest") == d}
        changed = sorted(set(digests) - set(held))
        folder = f"data-{uuid.uuid4().hex}"
        if changed:
            rows.filter(F.col("part").isin(*changed)).repartition("part").write.partitionBy("part").parquet(f"{log.path}/{folder}")
        written += len(changed)
        state["tables"][name] = {"schema": df.schema.json(), "parts": {str(p): held.get(p, {"digest": d, "at": f"{folder}/part={p}"}) for p, d in digests.items()}}
    log.commit(read, state)
    return written


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; another version of its form is refused."""
    log = CommitLog(spark, path)
    _, state = log.latest()
    if not state:
        raise FileNotFoundError(f"no snapshot under {path}")
    if state["version"] != VERSION:
        raise ValueError(f"unsupported snapshot version: {state['version']}")
    out = {}
    for name, table in state["tables"].items():
        schema = StructType.fromJson(json.loads(table["schema"]))
        paths = [f"{log.path}/{p['at']}" for p in table["parts"].values()]
        out[name] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return out


def drop_unused(spark: SparkSession, path: str) -> list[str]:
    """Delete folders that the last version doesn't name. Readers of earlier versions must be done."""
    log = CommitLog(spark, path)
    named = {p["at"].split("/")[0] for t in log.latest()[1].get("tables", {}).values() for p in t["parts"].values()}
    return log.drop_unnamed(named, "data-")


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """Bring a snapshot to or from a shared cache; parts that the target has aren't moved. False if there is none."""
    if not exists(spark, source):
        return False
    write(spark, target, read(spark, source))
    return True


def scoped_path(base: str, project_root: str, workspace_root: str) -> str:
    """``<base>/<project>-<hash>/<workspace>-<hash>``; worktrees of a project share its part."""
    part = lambda root, other: f"{safe_name(os.path.basename(root.rstrip('/')), other)}-{hashlib.sha256(root.encode()).hexdigest()[:16]}"
    return f"{base.rstrip('/')}/{part(project_root, 'project')}/{part(workspace_root, 'workspace')}"
