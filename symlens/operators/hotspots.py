"""Hotspots: decayed churn or commit counts of files, normalised to the hottest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlens.functions import exprs as E


def churn_scores(numstat: DataFrame, now: float, half_life_days: float = 30.0) -> DataFrame:
    """(root, path, score): sum of decayed churn. A row without a commit time weighs 1."""
    at = F.coalesce(F.col("commit_time"), F.lit(int(now)))
    weighed = E.churn(F.col("additions"), F.col("deletions")) * E.decay(at, now, half_life_days)
    return numstat.groupBy("root", "path").agg(F.sum(weighed).alias("score"))


def commit_scores(names: DataFrame) -> DataFrame:
    """(root, path, score): how often each path stands in a name-only log."""
    return names.filter("path <> ''").groupBy("root", "path").agg(F.count("*").cast("double").alias("score"))


def normalize(scores: DataFrame, max_files: int = 1000) -> DataFrame:
    """The first ``max_files`` of each root by score, over the root's highest score or 1 if that is less.

    The maximum is a small table by root; the cut is by score, then path.
    """
    top = scores.groupBy("root").agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
    order = Window.partitionBy("root").orderBy(F.desc("score"), "path")
    kept = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_files)
    return kept.join(top, "root").select("root", "path", (F.col("score") / F.col("top")).alias("score"))


def to_uris(scores: DataFrame) -> DataFrame:
    """(uri, score): paths under their roots as file URIs; the last root in order wins a URI."""
    full = scores.withColumn("uri", E.file_uri(F.concat("root", F.lit("/"), "path")))
    return full.groupBy("uri").agg(F.max_by("score", "root").alias("score"))


def top_hotspots(hotspots: DataFrame, limit: int = 20) -> DataFrame:
    return hotspots.orderBy(F.desc("score"), "uri").limit(limit)


def score_of(rows: DataFrame, hotspots: DataFrame, uri_col: str = "uri") -> DataFrame:
    """``rows`` and their file's ``hotspot``, 0 where there is none or the URI is null or empty."""
    scores = hotspots.select(F.col("uri").alias(uri_col), F.col("score").alias("hotspot"))
    return rows.join(scores, uri_col, "left").withColumn("hotspot", F.coalesce("hotspot", F.lit(0.0)))


def top_symbols(symbols: DataFrame, hotspots: DataFrame, limit: int = 10, complexity_cap: int = 50, uri: str | None = None) -> DataFrame:
    """The first ``limit`` symbols of each file (or of ``uri``) by kind, hotspot and complexity; ties in order of ``ord``."""
    rows = symbols if uri is None else symbols.filter(F.col("uri") == uri)
    cc, h = F.col("cyclomatic_complexity"), F.col("hotspot")
    scored = score_of(rows, hotspots).withColumns({"score": E.top_symbol_score(F.col("kind"), h, cc), "tech_debt": E.tech_debt(h, cc, complexity_cap)})
    order = Window.partitionBy("uri").orderBy(F.round("score", 9).desc(), "ord", "symbol_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
