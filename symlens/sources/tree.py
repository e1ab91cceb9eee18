"""Symbols from syntax-tree nodes (file, node_id, type, name, start_line, end_line, end_char)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlens.functions.schema import symbol_id

#: Node types that make a symbol, in the order they are looked for; diffs look for the first two rows only.
NODE_GROUPS = (
    ("function_declaration", "function_definition", "method_declaration", "method_definition"),
    ("class_declaration", "class_definition"),
    ("interface_declaration",),
    ("variable_declarator", "const_declaration"),
)


def kind_of(node_type: Column) -> Column:
    """Function, class, what the ingest calls interface, or variable (words and numbers are fixed values)."""
    return F.when(node_type.contains("function") | node_type.contains("method"), 12).when(node_type.contains("class"), 5).when(node_type.contains("interface"), 23).otherwise(13).cast("long")


def tree_symbols(nodes: DataFrame, for_diff: bool = False) -> DataFrame:
    """Symbols of named nodes; they start at character 0."""
    groups = NODE_GROUPS[:2] if for_diff else NODE_GROUPS
    rows = nodes.filter(F.col("type").isin(*[t for g in groups for t in g]) & F.col("name").isNotNull())
    end = F.coalesce("end_line", "start_line")
    flat = rows.select("name", kind_of(F.col("type")).alias("kind"), F.lit(None).cast("string").alias("container_name"), F.col("file").alias("uri"), F.col("start_line").cast("long").alias("start_line"), F.lit(0).cast("long").alias("start_char"), end.cast("long").alias("end_line"), F.coalesce("end_char", F.lit(0)).cast("long").alias("end_char"), "node_id")
    place = [F.col(c) for c in ("start_line", "start_char", "end_line", "end_char")]
    return flat.withColumn("symbol_id", symbol_id(F.col("uri"), F.col("name"), F.col("kind"), *place))


def preview(text: DataFrame, start: int, end: int, margin: int = 5) -> DataFrame:
    """(path, line_no, line) of a whole-text table (path, value) from ``margin`` lines before to as many after."""
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line_no").between(max(0, start - margin), end + margin)).withColumn("line", F.regexp_replace("line", r"\r$", ""))
