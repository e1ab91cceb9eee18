"""What stands at a place of a file: symbols, functions, and the figures of the function around a symbol.

Ranges begin with their start and end before their end, in lines and characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.functions.schema import COMPUTABLE_KINDS
from symlens.operators import metrics
from symlens.operators.intervals import BLOCK, LEVEL, blocks_around, blocks_of, contains_join, levels_of
from symlens.operators.scan import carried_forward, running_sum
from symlens.sources.tables import settle

#: Lines of a file that are scanned together.
BLOCK_LINES = 2048
FIGURES = ["cyclomatic_complexity", "lines_of_code", "nesting_depth"]


def symbols_at(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each of ``points`` (uri, line, char and columns of its own) with the ``symbol_id`` of the shortest symbol around it, by lines and then id.

    Both ends of a symbol's range count as within it, as for a cursor. Points
    without a symbol give no row, repeated ones a single one. Each distinct place
    is looked up once, and never meets all the symbols around it: the shortest
    one of each dyadic block of lines is found first.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    best = F.struct((F.col("end_line") - F.col("start_line")).alias("lines"), F.col("symbol_id")).alias("best")
    rows = symbols.filter("start_line <= end_line").select("uri", *map(long, metrics.PLACE), best)
    levels = levels_of(rows, "start_line", "end_line")
    asked = points.select("uri", "line", "char").filter("line IS NOT NULL").distinct()
    # the lines between a symbol's first and last: the best one of each block, and a row a place and size of block
    blocks = rows.select("uri", "best", F.inline(blocks_of(F.col("start_line") + 1, F.col("end_line") - 1, levels))).groupBy("uri", LEVEL, BLOCK).agg(F.min("best").alias("best"))
    within = asked.select("*", F.inline(blocks_around(F.col("line").cast("long"), levels))).hint("merge").join(blocks.hint("merge"), ["uri", LEVEL, BLOCK])
    # its first and last line, where characters matter: the best one of each pair of bounds
    bound = lambda line, low, high: F.struct(F.col(line).alias("line"), low.alias("low"), high.alias("high"))
    low, high, none = F.col("start_char"), F.col("end_char"), F.lit(None).cast("long")
    one = F.col("start_line") == F.col("end_line")
    both = F.array(F.when(one & low.isNotNull() & high.isNotNull(), bound("start_line", low, high)), F.when(~one & low.isNotNull(), bound("start_line", low, none)), F.when(~one & high.isNotNull(), bound("end_line", none, high)))
    bounds = rows.select("uri", "best", F.inline(F.array_compact(both))).groupBy("uri", "line", "low", "high").agg(F.min("best").alias("best"))
    beside = asked.hint("merge").join(bounds.hint("merge"), ["uri", "line"]).filter("(low IS NULL OR low <= char) AND (high IS NULL OR high >= char)")
    columns = ["uri", "line", "char", "best"]
    shortest = within.select(*columns).unionByName(beside.select(*columns)).groupBy("uri", "line", "char").agg(F.min("best").alias("best"))
    found = shortest.select(F.col("uri").alias("__uri"), F.col("line").alias("__line"), F.col("char").alias("__char"), "best.symbol_id")
    same = (F.col("uri") == F.col("__uri")) & (F.col("line") == F.col("__line")) & F.col("char").eqNullSafe(F.col("__char"))
    return points.distinct().hint("merge").join(found.hint("merge"), same).select(*points.columns, "symbol_id")


def innermost_functions(functions: DataFrame, points: DataFrame) -> DataFrame:
    """(file, line, char, node_id): the innermost function around each distinct point, null where there is none.

    ``functions`` are (file, node_id, lft) and the four places, properly nested;
    of equal ranges the one of the greater ``lft`` is the inner one. One sweep
    over starts, ends and points counts the functions open at each; the innermost
    open at a depth is the last that began at it. Files are swept in blocks of
    lines, so that a long one is not one task's.
    """
    at = lambda line, char: [F.col(line).cast("long").alias("line"), F.col(char).cast("long").alias("char")]
    real = functions.filter("start_line < end_line OR (start_line = end_line AND start_char < end_char)")
    tie = F.struct(-F.col("end_line").cast("long"), -F.col("end_char").cast("long"), F.col("lft").cast("long"))
    zero = F.lit(0).cast("long")
    none = F.struct(zero, zero, zero).alias("tie")
    nothing = F.lit(None).cast(functions.schema["node_id"].dataType)
    # at one place functions end before others begin, outer before inner ones, and points come last
    ends = real.select("file", *at("end_line", "end_char"), F.lit(0).alias("turn"), none, nothing.alias("node_id"), F.lit(-1).alias("step"))
    starts = real.select("file", *at("start_line", "start_char"), F.lit(1).alias("turn"), tie.alias("tie"), "node_id", F.lit(1).alias("step"))
    asked = points.select("file", *at("line", "char")).distinct().select("file", "line", "char", F.lit(2).alias("turn"), none, nothing.alias("node_id"), F.lit(0).alias("step"))
    order, block = ["line", "char", "turn", "tie"], F.floor(F.col("line") / BLOCK_LINES)
    deep = running_sum(ends.union(starts).union(asked), ["file"], order, block, "step", "depth").filter("step >= 0")
    found = carried_forward(settle(deep), ["file", "depth"], order, block, "node_id", "inner").filter("turn = 2")
    return found.select("file", "line", "char", F.when(F.col("depth") > 0, F.col("inner")).alias("node_id"))


def node_metrics(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, node_id) of ``wanted`` with the three figures of each, over all nodes below it.

    Only nodes that count are joined with the nodes that hold them.
    """
    own = nodes.join(wanted.select("file", "node_id").distinct().hint("merge"), ["file", "node_id"], "left_semi")
    key = F.struct("file", "node_id").alias("symbol_id")
    columns = ["lang", "type", "operators", "lft", "rgt", "start_line", "end_line"]
    counted = metrics.is_decision(F.col("lang"), F.col("type")) | metrics.is_logic(F.col("lang"), F.col("type"), F.coalesce("operators", F.array().cast("array<string>"))) | F.col("type").isin(*metrics.NESTING)
    holders = own.select(key, "file", (F.col("lft") + 1).alias("after"), F.col("rgt").alias("until"))
    inside = contains_join(nodes.filter(counted).select("file", *columns), holders, ["file"], "lft", "after", "until")
    rows = own.select(key, *columns).unionByName(inside.select("symbol_id", *columns))
    return metrics.symbol_metrics(rows).select("symbol_id.file", "symbol_id.node_id", *FIGURES)


def with_metrics(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """``symbols`` with the figures of functions, methods and constructors; null for other kinds and where no function is found.

    ``nodes`` are the named nodes of the files' syntax trees: (file, node_id,
    lang, type, operators, lft, rgt) and the four places. A symbol with a
    ``node_id`` has the figures of that node, any other those of the innermost
    function at its start. A function's figures count what functions within it hold.
    """
    columns = [c for c in symbols.columns if c not in FIGURES]
    able = F.col("kind").isin(*COMPUTABLE_KINDS)
    given = "node_id" in symbols.columns
    start = symbols.filter(able & F.col("node_id").isNull() if given else able)
    # none of these tables grows slower than the symbols, whatever their files' sizes say: no side is broadcast
    functions = nodes.filter(metrics.is_function(F.col("type"))).select("file", "node_id", "lft", *metrics.PLACE)
    inner = settle(innermost_functions(functions, start.select(F.col("uri").alias("file"), F.col("start_line").alias("line"), F.col("start_char").alias("char"))))
    around = inner.select(F.col("file").alias("uri"), F.col("line").alias("start_line"), F.col("char").alias("start_char"), F.col("node_id").alias("__around"))
    wanted = inner.filter("node_id IS NOT NULL").select("file", "node_id")
    if given:
        wanted = wanted.union(symbols.filter(able & F.col("node_id").isNotNull()).select("uri", "node_id"))
    figures = node_metrics(nodes, wanted).select(F.col("file").alias("uri"), F.col("node_id").alias("__node"), *FIGURES)
    rows = symbols.select(*columns).join(around.hint("merge"), ["uri", "start_line", "start_char"], "left")
    node = F.coalesce("node_id", "__around") if given else F.col("__around")
    rows = rows.withColumn("__node", F.when(able, node)).join(figures.hint("merge"), ["uri", "__node"], "left")
    return rows.select(*columns, *FIGURES)
