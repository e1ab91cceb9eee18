"""A synthetic workspace over the driver's tables: symbols, churn, edges and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlens.functions.schema import COMPUTABLE_KINDS, symbol_id
from symlens.operators import graph, hotspots
from symlens.operators.postings import PostingIndex
from symlens.sources.tables import scratch

#: 2002-01-01, the day that churn is weighed from, and the days before it that count.
NOW, WINDOW_DAYS = 1009843200, 90
PLACE = ("start_line", "start_char", "end_line", "end_char")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol a part; ``part`` is the part's key."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = k % 26 + 1
    metric = lambda c: F.when(kind.isin(*COMPUTABLE_KINDS), c).cast("long")
    rows = p.select(
        F.concat(F.lit("file:///repo_"), (k % 3).cast("string"), F.lit("/src/"), F.lower("p_type"), F.lit("_"), (k % 40).cast("string"), F.lit(".ts")).alias("uri"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name"),
        kind.alias("kind"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("container_name"),
        (k % 97).alias("start_line"),
        (k % 7).alias("start_char"),
        (k % 97 + F.col("p_size")).alias("end_line"),
        F.lit(0).cast("long").alias("end_char"),
        F.lit(None).cast("string").alias("detail"),
        metric(F.col("p_size")).alias("cyclomatic_complexity"),
        metric(F.col("p_size") + 1).alias("lines_of_code"),
        metric(k % 5).alias("nesting_depth"),
        k.alias("ord"),
        k.alias("part"),
    )
    key = symbol_id(F.col("uri"), F.col("name"), F.col("kind"), *map(F.col, PLACE))
    return rows.withColumns({"symbol_id": key, "request_uri": F.col("uri")})


def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn of the last days: a commit a line item, its file that of the part."""
    files = symbols(spark, sf_dir).select("uri", F.col("part").alias("l_partkey"))
    items = table(spark, sf_dir, "lineitem").withColumn("commit_time", epoch("l_shipdate")).filter(F.col("commit_time") >= NOW - WINDOW_DAYS * 86400)
    rows = items.join(files, "l_partkey")
    return rows.select(F.lit("").alias("root"), F.col("uri").alias("path"), "commit_time", F.col("l_quantity").alias("additions"), F.col("l_linenumber").cast("double").alias("deletions"))


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, score) of the workspace."""
    return hotspots.normalize(hotspots.churn_scores(numstat(spark, sf_dir), NOW)).select(F.col("path").alias("uri"), "score")


#: The stored workspace of a session and folder.
_STORED: dict[tuple[str, str], tuple[PostingIndex, DataFrame]] = {}


def stored(spark: SparkSession, sf_dir: str) -> tuple[PostingIndex, DataFrame]:
    """The stored index of :func:`symbols` and the stored scores of :func:`hot`, made once a session.

    The index comes to hold its symbols by upserts and a removal: a third of the
    files first has other names, a third comes later, and files that are removed
    again hold copies of these.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch(spark)
        index = PostingIndex(spark, f"{path}/index", buckets=32, shelves=8)
        rows = symbols(spark, sf_dir).drop("part")
        third = lambda i: rows.filter(F.crc32("uri") % 3 == i)
        moved = third(2).withColumn("uri", F.replace(F.col("uri"), F.lit("/src/"), F.lit("/gone/"))).withColumn("request_uri", F.col("uri"))
        index.upsert(third(0).unionByName(third(1).withColumn("name", F.concat(F.lit("old_"), "name"))).unionByName(moved))
        index.upsert(third(1))
        index.remove(moved.select("uri").distinct(), merge=False)
        index.upsert(third(2), merge=False)
        hot(spark, sf_dir).write.parquet(f"{path}/hot")
        _STORED[key] = index, spark.read.parquet(f"{path}/hot")
    return _STORED[key]


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges before the latest evidence is chosen: one a line item, from its part to another."""
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    size = part.agg(F.count("*").alias("n_parts"))
    names = symbols(spark, sf_dir).select("part", "symbol_id", "uri")
    ends = items.join(F.broadcast(size)).withColumn("callee", (F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n_parts"))
    caller = names.select(F.col("part").alias("l_partkey"), F.col("symbol_id").alias("caller_symbol_id"), F.col("uri").alias("evidence_uri"))
    callee = names.select(F.col("part").alias("callee"), F.col("symbol_id").alias("callee_symbol_id"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "call").when(F.col("l_linenumber") % 3 == 1, "reference").otherwise("import")
    rows = ends.join(caller, "l_partkey").join(callee, "callee")
    seq = F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_extendedprice").alias("c"))
    return rows.select("caller_symbol_id", "callee_symbol_id", kind.alias("edge_kind"), "evidence_uri", F.col("l_orderkey").alias("evidence_line"), F.col("l_linenumber").cast("long").alias("evidence_char"), seq.alias("seq"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edge_rows(spark, sf_dir)
    return graph.upsert_edges(rows.limit(0), rows)


def diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, first, last, event_id, event_type): a changed range an event."""
    e = table(spark, sf_dir, "events")
    uri = F.concat(F.lit("file:///repo_"), (F.col("user_id") % 3).cast("string"), F.lit("/src/economy_"), (F.col("user_id") % 40).cast("string"), F.lit(".ts"))
    first = F.col("event_id") % 90
    return e.select(uri.alias("uri"), first.alias("first"), (first + F.col("event_id") % 5).alias("last"), "event_id", "event_type")


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, change_type) of each changed file by its last event."""
    last = diff_ranges(spark, sf_dir).groupBy("uri").agg(F.max_by("event_type", "event_id").alias("t"))
    kind = F.when(F.col("t") == "signup", "added").when(F.col("t") == "error", "deleted").when(F.col("t") == "purchase", "renamed").otherwise("modified")
    return last.select("uri", kind.alias("change_type"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of symbol versions from the events: the user names the file, the event its version."""
    e = table(spark, sf_dir, "events")
    uri = F.concat(F.lit("file:///stream/"), F.col("user_id").cast("string"), F.lit(".ts"))
    zero = F.lit(0).cast("long")
    rows = e.select(
        F.lit("").alias("symbol_id"), F.when(F.col("event_type") != "error", F.concat(F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"))).alias("name"), F.lit(12).cast("long").alias("kind"), F.lit(None).cast("string").alias("container_name"),
        uri.alias("uri"), F.col("event_id").alias("start_line"), zero.alias("start_char"), F.col("event_id").alias("end_line"), zero.alias("end_char"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("long").alias("cyclomatic_complexity"),
        F.lit(None).cast("long").alias("lines_of_code"), F.lit(None).cast("long").alias("nesting_depth"), uri.alias("request_uri"), F.col("event_id").alias("ord"), F.col("event_id").alias("seq"),
    )
    return rows


def ast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested-set syntax trees: an order is a function, its lines nest while their number is below five."""
    i = table(spark, sf_dir, "lineitem")
    line, order = F.col("l_linenumber").cast("long"), F.col("l_orderkey").cast("string")
    pick = lambda c, *xs: F.array(*map(F.lit, xs))[(c % len(xs)).cast("int")]
    lang = pick(F.col("l_orderkey") / 10, "lua", "typescript", "go", "ruby", "python")
    one = i.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    kind = pick(F.col("p"), "if_statement", "for_statement", "while_statement", "binary_expression", "boolean_operator", "call_expression", "switch_case", "elif_clause")
    nodes = one.select(
        order.alias("symbol_id"), lang.alias("lang"), kind.alias("type"), F.array(pick(F.col("s"), "&&", "||", "and", "+")).alias("operators"),
        F.when(line < 5, line).otherwise(line * 10 + 50).alias("lft"), F.when(line < 5, 40 - line).otherwise(line * 10 + 51).alias("rgt"), line.alias("start_line"), (line + 3).alias("end_line"),
    )
    zero = lambda x: F.lit(x).cast("long")
    roots = one.select("l_orderkey").distinct().select(order.alias("symbol_id"), lang.alias("lang"), F.lit("function_declaration").alias("type"), F.array().cast("array<string>").alias("operators"), zero(0).alias("lft"), zero(1000).alias("rgt"), zero(2).alias("start_line"), (F.col("l_orderkey") % 60 + 2).alias("end_line"))
    return nodes.unionByName(roots)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, line_no, line): sixteen logs with counts, a commit an order and a row a line of it; every seventh row is binary."""
    head = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.lit(0).alias("n"), epoch("o_orderdate").cast("string").alias("line"))
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").alias("q"))
    counts = F.when(F.col("p") % 7 == 0, F.lit("-\t-")).otherwise(F.concat(F.col("q").cast("string"), F.lit("\t"), F.col("l_linenumber").cast("string")))
    rows = one.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.concat(counts, F.lit("\tsrc/f"), F.col("p").cast("string"), F.lit(".ts")).alias("line"))
    return head.unionByName(rows).select(F.concat(F.lit("/repo_"), (F.col("o") % 16).cast("string")).alias("root"), (F.col("o") * 100 + F.col("n")).alias("line_no"), "line")


def hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, line_no, line): a hunk header an event, with and without counts; an error's is a line of text that quotes one."""
    e, n = table(spark, sf_dir, "events"), (F.col("event_id") % 4).cast("string")
    at = (F.col("event_id") % 900 + 1).cast("string")
    new = F.when(F.col("event_id") % 5 == 0, at).otherwise(F.concat(at, F.lit(","), n))
    line = F.concat(F.when(F.col("event_type") == "error", "+").otherwise(""), F.lit("@@ -"), (F.col("user_id") % 50).cast("string"), F.lit(",2 +"), new, F.lit(" @@ "), F.col("event_type"))
    return e.select(F.lit("/repo").alias("root"), F.col("event_id").alias("line_no"), line.alias("line"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, line_no, line): a changed file a part, with every letter that a name-status list may have."""
    k, t = F.col("p_partkey"), F.lit("\t")
    name = F.concat(F.lit("src/"), F.col("p_name"), F.lit("_"), k.cast("string"), F.lit(".ts"))
    letter = F.array(*map(F.lit, ("A", "M", "D", "R100", "C075", "T")))[(k % 6).cast("int")]
    return table(spark, sf_dir, "part").select(F.lit("/repo").alias("root"), k.alias("line_no"), F.concat(letter, F.when((k % 6).isin(3, 4), F.concat(t, F.lit("old/"), k.cast("string"))).otherwise(""), t, name).alias("line"))


def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named nodes of the files' syntax trees: a part is a function of twenty lines, most with a function inside."""
    k, line = F.col("p_partkey"), F.col("p_partkey") * 20
    word = lambda c, *xs: F.array(*map(F.lit, xs))[(c % len(xs)).cast("int")]
    none = F.array().cast("array<string>")

    def node(no: int, kind, rgt: int, first: int, last: int, when=None, operators=None) -> Column:
        """A node at ``no`` in the order of the function's nodes, up to the bound ``rgt``."""
        one = F.struct((k * 20 + no).alias("lft"), (k * 20 + rgt).alias("rgt"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), (operators if operators is not None else none).alias("operators"), (line + first).alias("start_line"), (line + last).alias("end_line"))
        return one if when is None else F.when(when, one)

    tree = F.array(
        node(0, "function_declaration", 19, 0, 17),
        node(1, word(k, "if_statement", "if_expression", "switch_statement"), 4, 1, 8),
        node(2, "for_statement", 3, 2, 5, k % 2 == 0),
        node(5, word(k, "arrow_function", "lambda", "method_definition"), 12, 9, 15, k % 3 != 0),
        node(6, word(k, "binary_expression", "boolean_operator"), 7, 10, 10, k % 3 != 0, F.array(word(k, "&&", "and", "or", "+", "||"))),
        node(8, word(k, "while_statement", "while_expression"), 11, 11, 14, k % 3 != 0),
        node(9, "catch_clause", 10, 12, 13, (k % 3 != 0) & (F.col("p_size") % 2 == 0)),
    )
    rows = table(spark, sf_dir, "part").select(_file_of().alias("file"), word(k, "typescript", "lua", "python", "rust", "ruby").alias("lang"), F.inline(F.array_compact(tree)))
    start = (F.col("start_line") % 3).alias("start_char")
    return rows.select("file", F.concat("file", F.lit("#"), F.col("lft").cast("string")).alias("node_id"), "lang", "type", "operators", "lft", "rgt", "start_line", start, "end_line", F.lit(40).alias("end_char"))


def _file_of() -> Column:
    k = F.col("p_partkey")
    return F.concat(F.lit("file:///repo_"), (k % 3).cast("string"), F.lit("/tree/"), F.col("p_brand"), F.lit("_"), (k % 5).cast("string"), F.lit(".ts"))


def file_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server symbols of these files: one a part, somewhere in its twenty lines."""
    k = F.col("p_partkey")
    at = k * 20 + k % 20
    zero = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (k % 26 + 1).alias("kind"), _file_of().alias("uri"), at.alias("start_line"), (k % 4).alias("start_char"), (at + 1).alias("end_line"), zero.alias("end_char"))
    return rows.withColumn("symbol_id", symbol_id(F.col("uri"), F.col("name"), F.col("kind"), *map(F.col, PLACE)))


def graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(center_id, method, value): JSON answers about every symbol, a call or reference a line item; a fifth can't be prepared."""
    s = symbols(spark, sf_dir)
    items, size = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").agg(F.count("*").alias("n_parts"))
    rows = items.join(F.broadcast(size)).select(F.col("l_partkey").alias("c"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % F.col("n_parts")).alias("part"), (F.col("l_orderkey") % 500).alias("at"), F.col("l_linenumber").cast("long").alias("no"))
    # symbols are far larger than their parts' file, as their ids are made in the plan
    rows = rows.join(s.hint("merge"), "part").join(s.select(F.col("part").alias("c"), F.col("symbol_id").alias("center_id")).hint("merge"), "c")
    point = lambda line, char: F.struct(line.alias("line"), char.alias("character"))
    span = lambda line, char, to, end: F.struct(point(line, char).alias("start"), point(to, end).alias("end"))
    c, zero = F.col, F.lit(0).cast("long")
    item = F.struct("name", "kind", c("container_name").alias("detail"), "uri", span(c("start_line"), c("start_char"), c("end_line"), zero).alias("selectionRange"))
    places = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, (c("no") % 3).cast("int")), lambda j: span(c("at") + j, c("no"), c("at") + j, c("no") + 1))
    of = lambda method, some, x: rows.filter(some).groupBy("center_id").agg(F.to_json(F.collect_list(x)).alias("value")).select("center_id", F.lit(method).alias("method"), "value")
    incoming = of("incoming", c("no") % 4 < 2, F.struct(item.alias("from"), places.alias("fromRanges")))
    outgoing = of("outgoing", c("no") % 4 == 2, F.struct(item.alias("to"), places.alias("fromRanges")))
    references = of("references", c("no") % 4 == 3, F.struct("uri", span(c("at"), c("no"), c("at"), c("no") + 3).alias("range")))
    prepared = s.select(c("symbol_id").alias("center_id"), F.lit("prepare").alias("method"), F.when(c("part") % 5 != 0, F.to_json(F.array(F.struct("name", "kind", "uri")))).otherwise("null").alias("value"))
    return prepared.unionByName(incoming).unionByName(outgoing).unionByName(references)


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, line_no, line): diffs of four roots, an event a hunk; every tenth begins a file, and some files are gone."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    file = F.when(k % 70 == 0, F.lit("+++ /dev/null")).otherwise(F.concat(F.lit("+++ b/src/f"), (k % 1000).cast("string"), F.lit(".ts")))
    head = e.filter(k % 10 < 4).select((k % 4).alias("r"), (k * 3).alias("line_no"), file.alias("line"))
    hunk = e.select((k % 4).alias("r"), (k * 3 + 1).alias("line_no"), F.concat(F.lit("@@ -1 +"), (k % 300 + 1).cast("string"), F.when(k % 3 > 0, F.concat(F.lit(","), (k % 3).cast("string"))).otherwise(""), F.lit(" @@ x")).alias("line"))
    text = e.filter(k % 2 == 0).select((k % 4).alias("r"), (k * 3 + 2).alias("line_no"), F.lit("+++b/no.ts").alias("line"))
    return head.unionByName(hunk).unionByName(text).select(F.concat(F.lit("/repo_"), F.col("r").cast("string")).alias("root"), "line_no", "line")
