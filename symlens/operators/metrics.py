"""Complexity, size and nesting of symbols from syntax trees kept as nested sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlens.operators.intervals import contains_join

PLACE = ["start_line", "start_char", "end_line", "end_char"]

#: Node types that add a decision, by language; other languages take all of the last entry.
_JS = ("if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "switch_case", "catch_clause", "ternary_expression")
DECISIONS = {
    "lua": ("if_statement", "elseif_clause", "for_statement", "for_in_statement", "while_statement", "repeat_statement"),
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "python": ("if_statement", "elif_clause", "for_statement", "while_statement", "except_clause", "conditional_expression"),
    "go": ("if_statement", "for_statement", "expression_case", "type_case"),
    "rust": ("if_expression", "for_expression", "while_expression", "loop_expression", "match_arm"),
}
OTHER_DECISIONS = (
    "if_statement", "if_expression", "elseif_clause", "elif_clause", "for_statement", "for_in_statement", "for_expression", "while_statement", "while_expression", "repeat_statement",
    "do_statement", "loop_expression", "switch_case", "expression_case", "match_arm", "catch_clause", "except_clause", "ternary_expression", "conditional_expression",
)
#: The node type and words of logical operators, by language.
_C_LOGIC = ("binary_expression", ("&&", "||"))
LOGIC = {"lua": ("binary_expression", ("and", "or")), "javascript": _C_LOGIC, "typescript": _C_LOGIC, "tsx": _C_LOGIC, "python": ("boolean_operator", ("and", "or")), "rust": _C_LOGIC}
#: Node types that nest.
NESTING = (
    "if_statement", "if_expression", "elseif_clause", "elif_clause", "for_statement", "for_in_statement", "for_expression", "while_statement", "while_expression", "repeat_statement",
    "do_statement", "loop_expression", "switch_statement", "match_expression", "try_statement", "catch_clause", "except_clause",
)


def is_decision(lang: Column, kind: Column) -> Column:
    out = kind.isin(*OTHER_DECISIONS)
    for name, kinds in DECISIONS.items():
        out = F.when(lang == name, kind.isin(*kinds)).otherwise(out)
    return out


def is_logic(lang: Column, kind: Column, operators: Column) -> Column:
    """Whether a node's unnamed children hold a logical operator of its language."""
    out = F.lit(False)
    for name, (node, words) in LOGIC.items():
        out = F.when(lang == name, (kind == node) & F.arrays_overlap(operators, F.array(*map(F.lit, words)))).otherwise(out)
    return out


def symbol_metrics(nodes: DataFrame) -> DataFrame:
    """(symbol_id, cyclomatic_complexity, lines_of_code, nesting_depth).

    ``nodes`` are (symbol_id, lang, type, operators, lft, rgt, start_line,
    end_line); the outermost node of a symbol is its own and isn't counted. Depth
    is the highest number of nesting nodes open at once, from a running sum over
    their bounds: linear in the nodes, where pairs of ancestors would not be.
    """
    root = nodes.groupBy("symbol_id").agg(F.min("lft").alias("top"), F.min_by(F.struct("start_line", "end_line"), "lft").alias("lines"))
    inner = nodes.join(root.select("symbol_id", "top").hint("merge"), "symbol_id").filter("lft > top")
    points = F.when(is_decision(F.col("lang"), F.col("type")), 1).otherwise(0) + F.when(is_logic(F.col("lang"), F.col("type"), F.coalesce("operators", F.array().cast("array<string>"))), 1).otherwise(0)
    decided = inner.groupBy("symbol_id").agg(F.sum(points).alias("points"))
    bounds = inner.filter(F.col("type").isin(*NESTING)).select("symbol_id", F.explode(F.array(F.struct(F.col("lft").alias("at"), F.lit(1).alias("step")), F.struct(F.col("rgt").alias("at"), F.lit(-1).alias("step")))).alias("b"))
    # at one place nodes close before others open
    open_now = F.sum("b.step").over(Window.partitionBy("symbol_id").orderBy("b.at", "b.step").rowsBetween(Window.unboundedPreceding, 0))
    depth = bounds.select("symbol_id", open_now.alias("open")).groupBy("symbol_id").agg(F.max("open").alias("depth"))
    out = root.join(decided.hint("merge"), "symbol_id", "left").join(depth.hint("merge"), "symbol_id", "left")
    return out.select(
        "symbol_id",
        (1 + F.coalesce("points", F.lit(0))).cast("long").alias("cyclomatic_complexity"),
        (F.col("lines.end_line") - F.col("lines.start_line") + 1).cast("long").alias("lines_of_code"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("nesting_depth"),
    )


def is_function(kind: Column) -> Column:
    """Node types that enclose a function body."""
    return kind.contains("function") | kind.contains("method") | kind.isin("arrow_function", "lambda", "function_item")


def enclosing_function(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """For each (file, at) of ``points`` the smallest function around it: (file, at, node_id); null if none."""
    functions = nodes.filter(is_function(F.col("type"))).select("file", "node_id", "lft", "rgt")
    around = contains_join(points.select("file", "at").distinct(), functions, ["file"], "at", "lft", "rgt")
    best = around.groupBy("file", "at").agg(F.min_by("node_id", F.struct(F.col("rgt") - F.col("lft"), "node_id")).alias("node_id"))
    return points.join(best, ["file", "at"], "left")
