"""The symbol store: immutable tables; each change gives a new store.

Symbols belong to the URI they were sent for (``request_uri``). An upsert
replaces all symbols of its URIs; edges and hotspots stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlens.functions import schema as S
from symlens.operators import graph, hotspots, search
from symlens.sources import snapshot

PLACE = ["start_line", "start_char", "end_line", "end_char"]


def recomputed(batch: DataFrame, besides: Sequence[str] = ()) -> DataFrame:
    """The batch with ids of its own making; of equal ids of a URI the first by ``ord`` stays, of each value of the columns ``besides``."""
    rows = batch.withColumn("symbol_id", S.symbol_id(F.col("uri"), F.col("name"), F.col("kind"), *map(F.col, PLACE)))
    key = ["request_uri", "symbol_id", *besides]
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), "ord").alias("r"))
    return first.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in batch.columns])


def replace_symbols(existing: DataFrame, batch: DataFrame, uris: DataFrame | None = None, besides: Sequence[str] = ()) -> DataFrame:
    """All symbols of the batch's URIs (and of ``uris``, which may have none) give way to the batch's.

    An id that another URI already holds goes to the batch: the last one wins.
    Where symbols of one id are told apart by other columns, ``besides`` names
    these, none of them null: rows are then equal only if equal in them too.
    """
    new = recomputed(batch, besides)
    gone = new.select("request_uri")
    if uris is not None:
        gone = gone.union(uris.select(F.col("uri").alias("request_uri")))
    kept = existing.join(gone.distinct(), "request_uri", "left_anti").join(new.select("symbol_id", *besides), ["symbol_id", *besides], "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def remove_uris(existing: DataFrame, uris: DataFrame) -> DataFrame:
    """Symbols of other URIs than those in ``uris`` (uri)."""
    return existing.join(uris.select(F.col("uri").alias("request_uri")).distinct(), "request_uri", "left_anti").select(*existing.columns)


def lookup(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """A row of ``symbols`` for each row of ``ids`` (symbol_id) that names one, also where several rows hold the id: the first by ``ord``."""
    others = F.struct(*[c for c in symbols.columns if c != "symbol_id"])
    asked = ids.groupBy("symbol_id").agg(F.count("*").alias("__asked"))
    found = symbols.hint("merge").join(asked.hint("merge"), "symbol_id").groupBy("symbol_id", "__asked").agg(F.min_by(others, "ord").alias("r"))
    each = found.select("*", F.explode(F.array_repeat(F.lit(0), F.col("__asked").cast("int"))))
    return each.select(*[F.col(c) if c == "symbol_id" else F.col(f"r.{c}") for c in symbols.columns])


def stats(symbols: DataFrame, hot: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: symbol, URI, hotspot and edge counts."""
    counts = symbols.agg(F.count("*").alias("symbol_count"), F.count_distinct("request_uri").alias("uri_count"))
    return counts.join(hot.agg(F.count("*").alias("hotspot_count")), how="cross").join(edges.agg(F.count("*").alias("edge_count")), how="cross")


def stats_by_root(symbols: DataFrame, hot: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, symbol_count, uri_count, hotspot_count) for each root (name, uri_prefix), zeros included.

    Files are counted before they meet the roots, so that the prefix join sees a row a file.
    """
    files = symbols.groupBy(F.col("request_uri").alias("u")).agg(F.count("*").alias("s")).select("u", "s", F.lit(1).alias("f"), F.lit(0).alias("h"))
    rows = files.unionByName(hot.select(F.col("uri").alias("u"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("f"), F.lit(1).alias("h")))
    met = below(rows, roots, "u")
    counts = met.groupBy("name").agg(F.sum("s").alias("symbol_count"), F.sum("f").alias("uri_count"), F.sum("h").alias("hotspot_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return roots.select("name").join(counts, "name", "left").select("name", zero("symbol_count"), zero("uri_count"), zero("hotspot_count"))


def under_prefix(symbols: DataFrame, hot: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a snapshot of a root holds: its symbols, its hotspots, and edges with an end among its symbols."""
    own = symbols.filter(F.col("request_uri").startswith(prefix))
    # in one pass over the edges; ids may not be broadcast, as their size is guessed from files that hold them shorter
    ids = own.select(F.col("symbol_id").alias("__id"), F.lit(True).alias("__own")).distinct().hint("merge")
    touching = edges
    for end in ("caller", "callee"):
        touching = touching.join(ids.withColumnsRenamed({"__id": f"__{end}", "__own": f"__{end}_own"}), F.col(f"{end}_symbol_id") == F.col(f"__{end}"), "left")
    touching = touching.filter("__caller_own OR __callee_own").select(*edges.columns)
    return own, hot.filter(F.col("uri").startswith(prefix)), touching


def overlay_hotspots(hot: DataFrame, new: DataFrame) -> DataFrame:
    """The scores of ``new`` over those of ``hot``."""
    return hot.join(new.select("uri"), "uri", "left_anti").unionByName(new.select("uri", "score"))


@dataclass(frozen=True)
class SymbolStore:
    """Symbols, edges and hotspots with the operations on them."""

    spark: SparkSession
    symbols: DataFrame
    edges: DataFrame
    hotspots: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> SymbolStore:
        return SymbolStore(spark, spark.createDataFrame([], S.SYMBOLS), spark.createDataFrame([], S.EDGES), spark.createDataFrame([], S.HOTSPOTS))

    def _uris(self, uris: DataFrame | Iterable[str]) -> DataFrame:
        return uris if isinstance(uris, DataFrame) else self.spark.createDataFrame([(u,) for u in uris], "uri string")

    def upsert_symbols(self, batch: DataFrame, uris: DataFrame | Iterable[str] | None = None) -> SymbolStore:
        return replace(self, symbols=replace_symbols(self.symbols, batch, None if uris is None else self._uris(uris)))

    def remove_uris(self, uris: DataFrame | Iterable[str]) -> SymbolStore:
        return replace(self, symbols=remove_uris(self.symbols, self._uris(uris)))

    def upsert_edges(self, batch: DataFrame) -> SymbolStore:
        return replace(self, edges=graph.upsert_edges(self.edges, batch))

    def clear_edges(self) -> SymbolStore:
        return replace(self, edges=self.edges.limit(0))

    def set_hotspots(self, scores: DataFrame) -> SymbolStore:
        return replace(self, hotspots=scores.select("uri", "score"))

    def clear(self) -> SymbolStore:
        """Without symbols and hotspots; edges stay."""
        return replace(self, symbols=self.symbols.limit(0), hotspots=self.hotspots.limit(0))

    def get_symbols(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        if isinstance(ids, DataFrame):
            return self.symbols.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi")
        return self.symbols.filter(F.col("symbol_id").isin(*ids))

    def stats(self) -> DataFrame:
        return stats(self.symbols, self.hotspots, self.edges)

    def stats_by_root(self, roots: DataFrame) -> DataFrame:
        return stats_by_root(self.symbols, self.hotspots, roots)

    def search(self, q: str, limit: int = 50, complexity_cap: int = 50, kinds: list[int] | None = None) -> DataFrame:
        return search.search(self.symbols, q, limit, complexity_cap, kinds, self.hotspots)

    def search_batch(self, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
        return search.search_batch(self.symbols, queries, self.hotspots, index)

    def top_symbols(self, uri: str | None = None, limit: int = 10, complexity_cap: int = 50) -> DataFrame:
        return hotspots.top_symbols(self.symbols, self.hotspots, limit, complexity_cap, uri)

    def _ids(self, ids: DataFrame | Iterable[str]) -> DataFrame:
        return ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "symbol_id string")

    def outgoing(self, ids: DataFrame | Iterable[str]) -> DataFrame:
        return graph.outgoing(self.edges, self._ids(ids))

    def incoming(self, ids: DataFrame | Iterable[str]) -> DataFrame:
        return graph.incoming(self.edges, self._ids(ids))

    def save(self, path: str, uri_prefix: str | None = None) -> None:
        symbols, hot, edges = (self.symbols, self.hotspots, self.edges) if uri_prefix is None else under_prefix(self.symbols, self.hotspots, self.edges, uri_prefix)
        snapshot.write(self.spark, path, {"symbols": symbols, "hotspots": hot, "edges": edges})

    def close(self) -> None:
        """Let go of what the session has cached of the tables; the tables themselves stay."""
        for table in (self.symbols, self.edges, self.hotspots):
            table.unpersist()

    @staticmethod
    def load(spark: SparkSession, path: str) -> SymbolStore:
        tables = snapshot.read(spark, path)
        return SymbolStore(spark, tables["symbols"], tables["edges"], tables["hotspots"])

    def merge(self, path: str) -> SymbolStore:
        """This store with a snapshot's URIs, edges and scores over its own."""
        tables = snapshot.read(self.spark, path)
        return replace(self, symbols=replace_symbols(self.symbols, tables["symbols"]), edges=graph.upsert_edges(self.edges, tables["edges"]), hotspots=overlay_hotspots(self.hotspots, tables["hotspots"]))


def below(rows: DataFrame, roots: DataFrame, uri: str) -> DataFrame:
    """A row for each row and root whose ``uri_prefix`` its ``uri`` begins with, columns of both.

    A URI is cut at each length that a prefix has, and the cuts are looked up: an
    equi-join, whatever the number of roots. The driver gets the distinct lengths
    of prefixes, which are no more than the longest one has characters.
    """
    lengths = sorted(r[0] for r in roots.filter("uri_prefix IS NOT NULL").select(F.char_length("uri_prefix")).distinct().collect())
    cuts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length(uri)), lambda n: F.substring(F.col(uri), F.lit(1), n))
    return rows.withColumn("uri_prefix", F.explode(cuts)).join(roots, "uri_prefix")


def rooted(rows: DataFrame, roots: DataFrame, uri: Column) -> DataFrame:
    """``rows`` and the ``root`` with the longest prefix (name, uri_prefix) of their URI, of equal ones the last by name; null where none fits."""
    met = below(rows.select(uri.alias("__uri")).distinct(), roots.select("name", "uri_prefix"), "__uri")
    best = met.groupBy("__uri").agg(F.max_by("name", F.struct(F.char_length("uri_prefix"), F.col("name"))).alias("root"))
    return rows.withColumn("__uri", uri).join(best, "__uri", "left").drop("__uri")
