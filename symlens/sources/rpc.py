"""Request logs of newline-delimited JSON-RPC 2.0 as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error codes of JSON-RPC.
PARSE, INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
#: Methods of the symbol store, and the bytes that an upsert's parameters may have.
METHODS = (
    "initialize", "shutdown", "index/upsertSymbols", "index/removeUri", "index/removeUris", "index/stats", "index/getSymbolById", "search/query", "hotspot/setScores", "hotspot/getTopSymbols",
    "graph/upsertEdges", "graph/getOutgoingEdges", "graph/getIncomingEdges", "graph/clearEdges", "index/saveSnapshot", "index/loadSnapshot", "index/snapshotExists", "index/saveSnapshotForRoot",
    "index/loadSnapshotForRoot", "index/statsByRoot",
)
MAX_UPSERT_BYTES = 8 * 1024 * 1024


def requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id, method, params, error) of each line that isn't blank.

    ``params`` stays JSON text, ``null`` where absent. ``error`` is null for a
    good request. Messages without an id are notifications and are dropped;
    lines that don't parse have neither id nor method.
    """
    get = lambda path: F.get_json_object(value, path)
    whole = F.try_parse_json(F.col(value))
    rows = lines.filter(F.trim(F.col(value)) != "").select(whole.isNull().alias("bad"), get("$.id").alias("id"), get("$.method").alias("method"), F.coalesce(get("$.params"), F.lit("null")).alias("params"), get("$.jsonrpc").alias("version"))
    large = (F.col("method") == "index/upsertSymbols") & (F.octet_length("params") > MAX_UPSERT_BYTES)
    error = F.when(F.col("bad"), PARSE).when(~F.col("version").eqNullSafe(F.lit("2.0")), INVALID_REQUEST).when(~F.coalesce(F.col("method"), F.lit("")).isin(*METHODS), UNKNOWN_METHOD).when(large, INVALID_PARAMS)
    return rows.filter("bad OR id IS NOT NULL").select("id", "method", "params", error.alias("error"))


def response(request_id: Column, result: Column) -> Column:
    """A success response as a JSON line; ``result`` is a struct, map or array."""
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), request_id.cast("string"), F.lit(',"result":'), F.to_json(result), F.lit("}"))


def error_response(request_id: Column, code: Column, message: Column) -> Column:
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(request_id.cast("string"), F.lit("null")), F.lit(',"error":'), F.to_json(F.struct(code.alias("code"), message.alias("message"))), F.lit("}"))
