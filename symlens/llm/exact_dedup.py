"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Built-in expressions only. Normalised length, prefix hash and digest of a text
come out of one scan; what is shuffled afterwards are rows of some 60 bytes.
Each level passes on only rows whose key is shared, so the group by full digest
sees surviving rows alone. Digests are taken during the scan, since a columnar
scan can't revisit chosen rows and moving a digest is cheaper than moving a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import id_key, id_value, materialize

#: The characters of [\x20\x09-\x0D] that normalisation deletes.
WHITE = " \t\n\x0b\x0c\r"


def normalized(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, WHITE, "")


def _survivors(rows: DataFrame) -> DataFrame:
    """Rows that share length and prefix hash with another.

    Both levels are counted before rows are moved: a length counts through its
    prefixes, so that a hot length or prefix is one row a task by then.
    """
    prefixes = rows.groupBy("len", "prefix").agg(F.count("*").alias("n"))
    lengths = prefixes.groupBy("len").agg(F.sum("n").alias("n_len")).filter("n_len > 1").select("len")
    # tables of their own, here and below, let adaptive execution split what joins them
    shared = materialize(prefixes.join(lengths, "len", "left_semi").filter("n > 1").select("len", "prefix"), "exact-shared")
    return rows.join(shared, ["len", "prefix"], "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256, n_points).

    Texts are equal when they agree without ASCII white space. Of equal texts
    the one with most code points stays, then the smallest id. A null text
    counts as empty and an empty table gives no rows. Rows that share an id and
    a text are rows of their own: one of them is kept. A null id orders first
    and stays null in the result. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scan = (
        docs.select(id_key(id_col).alias("key"), F.char_length(text).alias("n_points"), normalized(text).alias("norm"))
        .select("key", "n_points", F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"), F.sha2("norm", 256).alias("digest"))
        .withColumn("row_no", F.monotonically_increasing_id())
    )
    rows = materialize(scan, "exact-rows")
    narrow = rows.select("key", "n_points", "len", "prefix", "digest", "row_no")
    survivors = _survivors(narrow)
    best = F.max(F.struct("n_points", F.bitwise_not("key").alias("rev"), F.bitwise_not("row_no").alias("rev_no")))
    groups = survivors.groupBy("len", "digest").agg(F.count("*").alias("size"), best.alias("best")).filter("size > 1")
    groups = groups.select("len", "digest", "size", F.bitwise_not("best.rev").alias("keep"), F.bitwise_not("best.rev_no").alias("keep_no"))
    out = rows.join(materialize(groups, "exact-groups"), ["len", "digest"], "left")
    alone = F.col("size").isNull()
    return out.select(
        id_value(F.col("key")).alias("doc_id"),
        id_value(F.when(alone, F.col("key")).otherwise(F.col("keep"))).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("keep_no"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("n_points").cast("long").alias("n_points"),
    )
