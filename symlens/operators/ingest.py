"""From files to symbols: the language server's answer where there is one, else the syntax tree, with a status a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.functions.schema import symbol_id
from symlens.operators.places import FIGURES, with_metrics
from symlens.operators.store import SymbolStore
from symlens.sources import lsp

PLACE = ["start_line", "start_char", "end_line", "end_char"]


@dataclass(frozen=True)
class Indexed:
    """Symbols of a run, with their ``method``, and (uri, status, method, symbol_count) of each file."""

    symbols: DataFrame
    status: DataFrame

    @property
    def summary(self) -> DataFrame:
        """One row of counts; skipped files aren't targets."""
        count = lambda s: F.count_if(F.col("status") == s)
        return self.status.agg((F.count("*") - count("skipped")).alias("target_count"), *[count(s).alias(f"{name}_count") for s, name in (("indexed", "indexed"), ("empty", "empty"), ("error", "failed"), ("skipped", "skipped"))])


def index_files(manifest: DataFrame, answers: DataFrame, server: DataFrame, tree: DataFrame, nodes: DataFrame | None = None, parsed: DataFrame | None = None) -> Indexed:
    """Index the files of ``manifest`` (uri, valid, buftype, filetype, is_file).

    ``answers`` (uri, ok) name the files that a server was asked for: an answer
    that is ok decides alone, even without symbols; a file without one, or with
    an error, takes the symbols of its syntax tree. ``server`` and ``tree`` hold
    symbols by ``uri``. Files not worth indexing are skipped; a file without
    symbols is empty. Repeated rows of a file count once.

    With ``nodes``, the files' syntax trees, functions, methods and constructors
    get their figures from them (:func:`symlens.operators.places.with_metrics`):
    a tree's symbol by its ``node_id``, a server's by its start. ``parsed`` (uri,
    ok) names files whose tree was asked for; one that isn't ok and is needed
    makes the file's status ``error``, without symbols.
    """
    files = manifest.select("uri").distinct().join(lsp.eligible(manifest).select("uri", F.lit(True).alias("good")).distinct(), "uri", "left")
    answered = answers.groupBy("uri").agg(F.max(F.coalesce("ok", F.lit(False))).alias("ok"))
    method = F.when(F.col("good") & F.coalesce("ok", F.lit(False)), "lsp").when(F.col("good"), "treesitter")
    chosen = files.join(answered, "uri", "left").select("uri", method.alias("method"))
    failed = F.lit(False)
    if parsed is not None:
        broken = parsed.groupBy("uri").agg((~F.max(F.coalesce("ok", F.lit(False)))).alias("broken"))
        chosen = chosen.join(broken, "uri", "left")
        failed = (F.col("method") == "treesitter") & F.coalesce("broken", F.lit(False))
    chosen = chosen.select("uri", "method", failed.alias("failed"))
    columns = [c for c in server.columns if c in tree.columns]
    held = [] if "node_id" in columns or "node_id" not in tree.columns else ["node_id"]
    none = [F.lit(None).cast(tree.schema[c].dataType).alias(c) for c in held]
    both = server.select(*columns, *none, F.lit("lsp").alias("method")).unionByName(tree.select(*columns, *held, F.lit("treesitter").alias("method")))
    symbols = both.join(chosen.filter("NOT failed"), ["uri", "method"], "left_semi")
    found = symbols.groupBy("uri").agg(F.count("*").alias("symbol_count"))
    if nodes is not None:
        symbols = with_metrics(symbols.select(*columns, *held, "method"), nodes)
        columns = [*[c for c in columns if c not in FIGURES], *FIGURES]
    symbols = symbols.select(*columns, "method")
    status = F.when(F.col("method").isNull(), "skipped").when(F.col("failed"), "error").when(F.col("symbol_count") > 0, "indexed").otherwise("empty")
    rows = chosen.join(found, "uri", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)).cast("long"))
    return Indexed(symbols, rows.select("uri", status.alias("status"), "method", "symbol_count"))


def upsert_files(store: SymbolStore, indexed: Indexed, again: bool = False, session: DataFrame | None = None) -> SymbolStore:
    """The store with the run's files replaced.

    ``again``, as a full reindex does, first removes the files that this
    ``session`` (uri) has indexed; all files of the store where none is given.
    Files that came by a snapshot alone then stay.
    """
    before = store
    if again:
        before = store.remove_uris(store.symbols.select(F.col("request_uri").alias("uri")) if session is None else session)
    batch = indexed.symbols.withColumn("request_uri", F.col("uri"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in store.symbols.schema.fields if f.name not in batch.columns]
    whole = batch.select("*", *missing).select(*store.symbols.columns)
    return before.upsert_symbols(whole, indexed.status.filter("status IN ('indexed', 'empty')").select("uri"))


def with_ids(items: DataFrame) -> DataFrame:
    """``items`` with missing places as 0, missing texts as empty and an id of their own where they have none."""
    text, number = ["symbol_id", "name", "uri"], ["kind", *PLACE]
    whole = items.withColumns({c: F.coalesce(c, F.lit("")) for c in text} | {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in number})
    own = symbol_id(F.col("uri"), F.col("name"), F.col("kind"), *map(F.col, PLACE))
    return whole.withColumn("symbol_id", F.when(F.col("symbol_id") == "", own).otherwise(F.col("symbol_id")))
