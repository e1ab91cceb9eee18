"""Edges between symbols: latest evidence, neighbours, centred views and bounded reverse reach."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.operators.intervals import contains_join
from symlens.sources import lsp
from symlens.sources.tables import settle

KEY = ["caller_symbol_id", "callee_symbol_id", "edge_kind"]
SECTIONS = ("center", "incoming", "outgoing", "reference")


def upsert_edges(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """One row an edge key: of equal keys the one with the greatest ``seq``, the batch over what was there."""
    every = existing.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    rows = F.struct(*[F.col(c) for c in existing.columns if c not in KEY])
    # a maximum is taken before the shuffle already, where a window would move every row
    latest = every.groupBy(*KEY).agg(F.max_by(rows, F.struct("__new", "seq")).alias("r"))
    return latest.select(*[F.col(c) if c in KEY else F.col(f"r.{c}") for c in existing.columns])


def outgoing(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose caller is among ``ids`` (symbol_id)."""
    return edges.join(ids.select(F.col("symbol_id").alias("caller_symbol_id")).distinct(), "caller_symbol_id", "left_semi")


def incoming(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose callee is among ``ids`` (symbol_id)."""
    return edges.join(ids.select(F.col("symbol_id").alias("callee_symbol_id")).distinct(), "callee_symbol_id", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(symbol_id, caller_count, callee_count) over all kinds, in one aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("callee_symbol_id").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("caller_symbol_id").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.symbol_id").agg(F.sum("e.i").alias("caller_count"), F.sum("e.o").alias("callee_count"))


def call_graph(items: DataFrame) -> DataFrame:
    """Rows of a centred view: one a section and symbol, their counts summed, in order of sections and counts.

    ``items`` are (section, symbol_id, name, kind, container_name, uri,
    start_line, start_char, n); ``n`` are the ranges of a call, 1 where null.
    """
    place = F.struct("name", "kind", "container_name", "uri", "start_line", "start_char")
    rows = items.groupBy("section", "symbol_id").agg(F.sum(F.coalesce("n", F.lit(1))).alias("edge_count"), F.min(place).alias("p"))
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    out = rows.select("section", "symbol_id", "p.*", "edge_count", (F.col("section") != "center").alias("expandable"))
    return out.orderBy(order, F.desc("edge_count"), "name", "uri", "start_line", "start_char", "symbol_id")


def centred_items(symbols: DataFrame, edges: DataFrame, center: DataFrame) -> DataFrame:
    """Items for :func:`call_graph` from stored edges around the one symbol in ``center`` (symbol_id)."""
    calls, refs = edges.filter("edge_kind = 'call'"), edges.filter("edge_kind = 'reference'")
    ends = [
        center.select(F.lit("center").alias("section"), "symbol_id"),
        incoming(calls, center).select(F.lit("incoming").alias("section"), F.col("caller_symbol_id").alias("symbol_id")),
        outgoing(calls, center).select(F.lit("outgoing").alias("section"), F.col("callee_symbol_id").alias("symbol_id")),
        incoming(refs, center).select(F.lit("reference").alias("section"), F.col("caller_symbol_id").alias("symbol_id")),
    ]
    found = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    return found.join(symbols, "symbol_id").select("section", "symbol_id", "name", "kind", "container_name", "uri", "start_line", "start_char", F.lit(1).alias("n"))


def resolve_items(items: DataFrame, symbols: DataFrame, how: str = "strict") -> DataFrame:
    """``items`` (symbol_id, name, uri, start_line, ...) whose symbol the index has.

    Call hierarchies hash the selection range where the index hashes the whole
    one. ``strict`` keeps items whose id is in the index; ``containment`` also
    gives any other item the id of the smallest symbol of its file and name around
    its start.
    """
    if how == "strict":
        return items.join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi")
    if how != "containment":
        raise ValueError(f"how must be strict or containment, got {how}")
    found = containing_ids(items.select("symbol_id", "name", "uri", "start_line").distinct(), symbols)
    return items.join(found, "symbol_id").withColumn("symbol_id", F.col("found")).select(*items.columns)


def containing_ids(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, found): for each item (symbol_id, name, uri, start_line) itself where it is a symbol, else the smallest symbol of its file and name around its start."""
    ids = symbols.select("symbol_id").distinct()
    own = items.join(ids.hint("merge"), "symbol_id", "left_semi").select("symbol_id", F.col("symbol_id").alias("found"))
    others = items.join(ids.hint("merge"), "symbol_id", "left_anti")
    around = symbols.select(F.col("symbol_id").alias("found"), "name", "uri", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    met = contains_join(others, around, ["uri", "name"], "start_line", "from_line", "to_line")
    best = met.groupBy("symbol_id").agg(F.min_by("found", F.struct(F.col("to_line") - F.col("from_line"), F.col("found"))).alias("found"))
    return own.distinct().unionByName(best)


@dataclass(frozen=True)
class CentredGraphs:
    """Rows of the views, by ``center_id`` and in the form of :func:`call_graph`, and the edges to store."""

    items: DataFrame
    edges: DataFrame

    @property
    def view(self) -> DataFrame:
        """Rows in order of centres, sections and counts."""
        order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
        return self.items.orderBy("center_id", order, F.desc("edge_count"), "name", "uri", "start_line", "start_char", "symbol_id")


def centred_graphs(centers: DataFrame, answers: DataFrame, symbols: DataFrame | None = None) -> CentredGraphs:
    """Call graphs around ``centers`` from what a language server answered.

    ``centers`` are symbols; ``answers`` are (center_id, method, value), a method
    of ``prepare``, ``incoming``, ``outgoing`` and ``references`` and its result
    as JSON text. Calls count only for a centre that could be prepared; an answer
    that can't be read has no items. Items of a section with one id are one row,
    their ranges summed, at least one a call. A centre has a row of its own, with
    count 0, even if nothing was found. Each range of a call is an edge, from the
    caller's file, or where it names none from the item's own range; a reference
    is an edge from its place, which has an id of its own. With ``symbols``,
    callers and callees whose name and start lie in a symbol of theirs take its id,
    unless they are symbols by their own.
    """
    ready = answers.filter((F.col("method") == "prepare") & F.col("value").rlike(r"^\s*(\[\s*)?\{")).select("center_id").distinct()
    # tables of the size of centres or items are not broadcast, whatever their files' sizes say
    calls, refs = None, lsp.references(answers.filter("method = 'references'"))
    for section in ("incoming", "outgoing"):
        part = lsp.calls(answers.filter(F.col("method") == section).join(ready.hint("merge"), "center_id", "left_semi"), section)
        calls = part if calls is None else calls.unionByName(part)
    if symbols is not None:
        calls = settle(calls)
        found = containing_ids(calls.select("symbol_id", "name", "uri", "start_line").distinct(), symbols)
        calls = calls.join(found.hint("merge"), "symbol_id", "left").withColumn("symbol_id", F.coalesce("found", "symbol_id")).drop("found")
    place = ["name", "kind", "container_name", "uri", "start_line", "start_char"]
    both = calls.withColumn("n", F.greatest(F.size("ranges"), F.lit(1))).select("center_id", "section", "symbol_id", *place, "n").unionByName(refs.select("center_id", "section", "symbol_id", *place, F.lit(1).alias("n")))
    known = both.join(centers.select(F.col("symbol_id").alias("center_id")).distinct().hint("merge"), "center_id", "left_semi")
    rows = known.groupBy("center_id", "section", "symbol_id").agg(F.sum("n").alias("edge_count"), F.min(F.struct(*place)).alias("p"))
    around = rows.select("center_id", "section", "symbol_id", "p.*", "edge_count", (F.col("section") != "reference").alias("expandable"))
    own = centers.select(F.col("symbol_id").alias("center_id"), F.lit("center").alias("section"), "symbol_id", *place, F.lit(0).cast("long").alias("edge_count"), F.lit(True).alias("expandable"))
    # rows of centers with one id are one centre, of one file
    files = centers.groupBy(F.col("symbol_id").alias("center_id")).agg(F.min("uri").alias("center_uri")).hint("merge")
    # a call without ranges is evidenced by the item's own
    ranged = calls.withColumn("at", F.explode(F.when(F.size("ranges") > 0, F.col("ranges")).otherwise(F.array(F.struct(F.col("start_line").alias("line"), F.col("start_char").alias("char")))))).join(files, "center_id")
    inward = F.col("section") == "incoming"
    ends = [F.when(inward, F.col("symbol_id")).otherwise(F.col("center_id")).alias("caller_symbol_id"), F.when(inward, F.col("center_id")).otherwise(F.col("symbol_id")).alias("callee_symbol_id")]
    call_edges = ranged.select(*ends, F.lit("call").alias("edge_kind"), F.when(inward, F.col("uri")).otherwise(F.col("center_uri")).alias("evidence_uri"), F.col("at.line").alias("evidence_line"), F.col("at.char").alias("evidence_char"))
    ref_edges = refs.join(files, "center_id").select(F.col("symbol_id").alias("caller_symbol_id"), F.col("center_id").alias("callee_symbol_id"), F.lit("reference").alias("edge_kind"), F.col("uri").alias("evidence_uri"), F.col("start_line").alias("evidence_line"), F.col("start_char").alias("evidence_char"))
    return CentredGraphs(own.unionByName(around), call_edges.unionByName(ref_edges))


def filter_view(view: DataFrame, text: str) -> DataFrame:
    """The centre, and rows that hold ``text`` in any case in name, container, detail (where there is one) or path; all for an empty text."""
    t = text.lower()
    hit = F.lit(t == "") | (F.col("section") == "center")
    for c in [c for c in ("name", "container_name", "detail", "uri") if c in view.columns]:
        hit |= F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t)
    return view.filter(hit)


def section_counts(view: DataFrame) -> DataFrame:
    return view.groupBy("section").agg(F.count("*").alias("n"))


def affected(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(symbol_id, depth): what reaches ``seeds`` (symbol_id) against the edges' direction within ``hops``, seeds left out.

    Each hop joins the new frontier with the edges and anti-joins what has been
    seen, so a node is expanded once, at its least depth. Frontiers and reversed
    edges are written as tables: otherwise each hop would plan and run all
    earlier ones again.
    """
    back = settle(edges.select(F.col("callee_symbol_id").alias("symbol_id"), F.col("caller_symbol_id").alias("caller")).distinct())
    frontier = settle(seeds.select("symbol_id").distinct())
    seen, found = frontier, frontier.limit(0).withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        step = frontier.join(back, "symbol_id").select(F.col("caller").alias("symbol_id")).distinct()
        frontier = settle(step.join(seen, "symbol_id", "left_anti"))
        seen, found = seen.union(frontier), found.union(frontier.withColumn("depth", F.lit(depth)))
    return found


class History:
    """Visited centres as in a browser: pushing drops what lay ahead."""

    def __init__(self):
        self.items: list = []
        self.at = -1

    def push(self, item) -> None:
        self.items[self.at + 1 :] = [item]
        self.at += 1

    def back(self):
        """The item before the present one, which becomes the present one; None at the start."""
        if self.at < 1:
            return None
        self.at -= 1
        return self.items[self.at]

    def refresh(self, view):
        """``view`` of the present item anew; None where there is none."""
        return None if self.current is None else view(self.current)

    @property
    def current(self):
        return self.items[self.at] if self.at >= 0 else None
