"""Table schemas and the fixed domain of symbol kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 26 symbol kinds of the Language Server Protocol, ids from 1 in this order.
KIND_NAMES = (
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface", "Function", "Variable",
    "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember", "Struct", "Event", "Operator", "TypeParameter",
)

#: Named groups of kinds that searches filter by; all kinds is no filter.
KIND_GROUPS = {"All": None, "Func": [6, 9, 12], "Class": [5, 11, 23], "Var": [7, 8, 13, 14], "Type": [10, 22, 26]}
COMPUTABLE_KINDS = (6, 9, 12)
EDGE_KINDS = ("call", "reference", "import")

#: Symbols are kept flat: ranges and metrics as columns, so that filters on them reach the scan.
SYMBOLS = (
    "symbol_id string, name string, kind long, container_name string, uri string, start_line long, start_char long, end_line long, end_char long, "
    "detail string, cyclomatic_complexity long, lines_of_code long, nesting_depth long, request_uri string, ord long"
)
EDGES = "caller_symbol_id string, callee_symbol_id string, edge_kind string, evidence_uri string, evidence_line long, evidence_char long, seq long"
HOTSPOTS = "uri string, score double"
QUERIES = "qid long, q string, lim int, complexity_cap long, kinds array<long>"


def kind_name(kind: Column) -> Column:
    """Display name; an unknown id is ``Unknown``."""
    names = F.array(*map(F.lit, KIND_NAMES))
    return F.coalesce(F.when(kind.between(1, len(KIND_NAMES)), names[(kind - 1).cast("int")]), F.lit("Unknown"))


def kind_id(kind: Column) -> Column:
    """Id of a kind given as a name or a number in text; unknown names are 0."""
    position = F.array_position(F.array(*map(F.lit, KIND_NAMES)), kind)
    return F.coalesce(kind.try_cast("long"), position, F.lit(0).cast("long"))


def symbol_id(uri: Column, name: Column, kind: Column, *place: Column) -> Column:
    """SHA-256 of ``uri:name:kind:start line:start char:end line:end char`` in hex; nulls are empty or 0."""
    parts = [F.coalesce(uri, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(kind.cast("string"), F.lit("0"))]
    return F.sha2(F.concat_ws(":", *parts, *[F.coalesce(p.cast("string"), F.lit("0")) for p in place]), 256)
